import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.languages import BUCKETS, LANGUAGES, Model, document_languages, gram_counts, is_sentence, label_language, language_segments, read_languages, scan, sentence_languages, train, wrong_labels
from lectern.llm.sentences import units

WORDS = {
    "en": "the ministry will publish results of this review for every resident who asked about grants and services again".split(),
    "zh": list("我们支持这项动议也希望教育部多听取居民的意见因为补助金将会降低但没有说明日期"),
    "ms": "kerana pejabat itu ditutup pada petang rakyat mahu melihat projek saliran siap sebelum hujung tahun bolehkah menteri jelaskan".split(),
    "ta": "அலுவலகம் மாலை மணிக்கு மூடப்படுகிறது இந்தத் தீர்மானத்தை நான் ஆதரிக்கிறேன் விகிதம் உயர்ந்தது".split(),
    "id": "karena kantor pemerintah bisa ditinjau ulang bagi pembeli rumah pertama mengapa nelayan harus menunggu padahal buka setiap hari".split(),
}


def sentence(rng, lang):
    w = [rng.choice(WORDS[lang]) for _ in range(rng.randrange(7, 14))]
    return ("".join(w) + "。") if lang == "zh" else " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang = LANGUAGES[i % 5]
        text = " ".join(sentence(rng, lang) for _ in range(rng.randrange(2, 6)))
        label = lang
        if i % 10 == 3:
            label = rng.choice([None, "", "unknown", "xx"])
        elif i % 10 == 7:
            label = LANGUAGES[(i + 1) % 5]
        rows.append((i, text, label, lang))
    rows += [(1000, sentence(rng, "en") + " " + sentence(rng, "zh"), "en", "mixed"), (1001, "Order paper 12/2019\n" + sentence(rng, "zh"), "zh-CN", "zh"), (1002, None, None, None), (1003, " \n", None, None), (1004, "12.5 / 14 --- !!!", None, None), (1005, sentence(rng, "ms") * 3000, "Malay", "ms"), (1006, sentence(rng, "id"), "Bahasa Indonesia", "id")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, true string")


@pytest.fixture(scope="module")
def model(docs):
    return train(docs)


def test_wrong_labels(docs, model):
    got = {(r.doc_id, r.lang) for r in wrong_labels(docs, model).collect()}
    rows = docs.collect()
    expected = {(r.doc_id, r.true) for r in rows if r.doc_id < 1000 and r.lang != r.true} | {(1000, "en"), (1000, "zh")}
    assert len(got ^ expected) <= 0.02 * len(expected), sorted(got ^ expected)
    assert {x for x in got if x[0] >= 1000} == {(1000, "en"), (1000, "zh")}


def test_held_out_sentences(model):
    rng = random.Random(99)
    tries = [(k, sentence(rng, k)) for k in LANGUAGES for _ in range(60)]
    right = sum(read_languages([s], model)[0][0] == k for k, s in tries)
    assert right / len(tries) > 0.98
    assert read_languages(["Ω≈ç√ шщжы ьъэ."], model)[0] == [None]


def test_segments(docs, model):
    got = sorted((r.segment, r.lang) for r in language_segments(docs.where("doc_id = 1000"), model).collect())
    assert got == [(0, "en"), (1, "zh")]
    assert language_segments(docs.where("doc_id >= 1002 AND doc_id <= 1004"), model).count() == 0
    assert all(0 <= r.confidence <= 1 for r in sentence_languages(docs, model).collect())


def test_every_document_with_text_in_a_language_has_one(docs, model):
    got = {r.doc_id: r for r in document_languages(docs, model).collect()}
    assert set(got) == {r.doc_id for r in docs.collect()} - {1002, 1003, 1004}
    assert got[1000].lang in ("en", "zh") and set(got[1000].langs) == {"en", "zh"} and abs(sum(got[1000].shares) - 1) < 1e-3
    heading = docs.sparkSession.createDataFrame([(1, "The review of grants", "zh"), (2, "教育部", None), (3, "12 - 7", None), (1, "The review of grants", "zh")], "doc_id long, text string, lang string")
    rows = sorted((r.doc_id, r.lang, r.langs) for r in document_languages(heading, model).collect())
    assert rows == [(1, "en", []), (1, "en", []), (2, "zh", [])]
    assert all(r.confidence <= 0.5 for r in document_languages(heading, model).collect()) and wrong_labels(heading, model).count() == 0


def test_the_confidence_is_of_the_language_given():
    idf = np.ones(BUCKETS, np.float32)
    close = Model(idf, np.zeros((BUCKETS, 5), np.float32), np.arange(5), np.zeros(5))
    tables = iter([np.array([[0.9, 0, 0, 0, 0.1], [0.50, 0, 0, 0, 0.51], [0.1, 0.6, 0, 0, 0]], np.float32)])
    close = type("Fixed", (), {"cosines": lambda self, s: next(tables), "least": close.least})()
    langs, sure = read_languages(["a", "b", "c"], close)
    # the second is nearer to id by a little, and goes with the document's main language: nothing speaks for en by itself
    assert langs == ["en", "en", "zh"] and sure[1] == 0.0 and sure[0] == pytest.approx(0.8889, abs=1e-3)


def test_one_scan_samples_the_first_by_hash(docs):
    df, total, samples = scan(docs, 3, 7)
    rows = docs.where("length(trim(text)) > 1").withColumn("l", label_language(F.col("lang"))).withColumn("h", F.xxhash64("doc_id", F.lit(7))).orderBy("h").collect()
    for k in LANGUAGES:
        texts = [r.text for r in rows if r.l == k][:3]
        found = [{x for a, b in units(t) if is_sentence(x := t[a:b])} for t in texts]
        assert len(samples[k]) == sum(min(2, len(f)) for f in found) and set(samples[k]) <= set().union(*found)
    texts = [r.text for r in docs.collect() if r.text and not r.text.isspace()]
    assert total == len(texts)
    s, b, _ = gram_counts(texts)
    assert (np.bincount(b, minlength=BUCKETS) == df).all()


def test_labels(spark):
    names = ["EN", "en-SG", "English", "zho", "zh-CN", "Mandarin", "msa", "Bahasa Melayu", "bahasa indonesia", "tam", "und", "", None, "xx", "-"]
    df = spark.createDataFrame([(n,) for n in names], "lang string").select(label_language(F.col("lang")))
    assert [r[0] for r in df.collect()] == ["en", "en", "en", "zh", "zh", "zh", "ms", "ms", "id", "ta", None, None, None, None, None]


def test_counts_and_sentences():
    s, b, n = gram_counts(["aa", "", "1 2"])
    assert set(s) == {0} and n.max() == 2
    assert [is_sentence(x) for x in ("Yes.", "Order paper 12/2019", "1.2 / 3.", "A line of many words here", "🙂")] == [True, False, False, True, False]


def test_no_labels_at_all(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = train(empty)
    assert isinstance(m, Model) and wrong_labels(empty, m).count() == 0
    some = spark.createDataFrame([(1, "Some text here.", None)], empty.schema)
    assert wrong_labels(some, train(some)).count() == 0
