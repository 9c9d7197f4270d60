"""Plans whose SQL or older test sees a part of the rows, against brute force over all of them."""

import datetime
import hashlib
import re

import pytest

from lectern.functions.text import MARKS_FROM, MARKS_TO
from lectern.operators.current import Tables
from lectern.plans.documents import R as DOCUMENTS
from lectern.plans.texts import R as TEXTS
from lectern.plans.texts import sentence_rows


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def normal(t):
    """The normal form and the place of each of its characters."""
    flat = [" " if re.match(r"[ \t\n\x0b\f\r]", c) else c for c in t.translate(str.maketrans(MARKS_FROM, MARKS_TO))]
    kept = [(c, i) for i, c in enumerate(flat) if not (c == " " and (i == 0 or flat[i - 1] == " "))]
    if kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(c for c, _ in kept), [i for _, i in kept]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with turns and chunks that are hard to anchor."""
    d, at = tmp_path_factory.mktemp("made"), datetime.datetime(2024, 1, 1)
    turns = [
        ("r1", 2011, "The grant is paid late. He said “we will look into the service standard” again. Yes."), ("r1", 2011, "Yes. The grant is paid late. And that is all that I wish to say here today."),
        ("r1", 2011, "  A  text with blanks — and a dash, which stands in one turn only.  "), ("r2", 1999, "The grant is paid late. " + "A sentence of more than thirty words goes on " * 6 + "and ends."),
        ("r2", 1999, "我们会检讨这项政策。谢谢议长先生, 我们会检讨。"), ("r2", 1999, None), ("r2", 1999, ""),
    ]
    chunks = [
        ("r1", 'He said "we will look into the service standard" again.'), ("r1", "A text with blanks - and a dash, which stands in one turn only."), ("r1", "This was never said by anyone in this report at all."), ("r1", "he grant is paid lat"), ("r1", "wish to say here to"),
        ("r2", "会检讨这项政策。谢谢议长"), ("r2", "The grant is paid late."), ("r2", " "), ("r2", None), ("r2", 'He said "we will look'),
    ]
    rows = [(f"k{i}", r, i, "Mr A", y, t, at) for i, (r, y, t) in enumerate(turns)]
    spark.createDataFrame(rows, "key string, report_id string, turn int, speaker string, year int, text string, loaded_at timestamp").write.parquet(f"{d}/turn.parquet")
    spark.createDataFrame([(f"c{i}", r, t, at) for i, (r, t) in enumerate(chunks)], "id string, report_id string, cite_text string, loaded_at timestamp").write.parquet(f"{d}/chunk.parquet")
    return str(d)


def anchored(spark, d):
    t = Tables(spark, d)
    turns = [(r.report_id, r.key, r.text, *normal(r.text)) for r in t.turn.where("text IS NOT NULL").collect()]
    probes = {(r.report_id, r.s) for r in sentence_rows(t).collect()} | {(r.report_id, r.cite_text) for r in t.chunk.where("cite_text IS NOT NULL").collect()}
    out = set()
    for rid, s in probes:
        form, _ = normal(s)
        hits = [x for x in turns if form and x[0] == rid and form in x[3]]
        if len(hits) != 1:
            out.add((rid, md5(s), len(hits), None, None, None, "ambiguous" if hits else "unresolved"))
            continue
        _, key, text, n, places = hits[0]
        if s in text:
            out.add((rid, md5(s), 1, key, text.index(s), text.index(s) + len(s), "exact"))
        else:
            a = n.index(form)
            out.add((rid, md5(s), 1, key, places[a], places[a + len(form) - 1] + 1, "normalised"))
    return out


def test_anchor_spans(spark, data, made):
    for d in (data, made):
        rows = [(r.report_id, r.probe_md5, r.hits, r.key, r.char_start, r.char_end, r.method) for r in DOCUMENTS.plans["anchor_spans"](spark, d).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == anchored(spark, d)
    assert {x[-1] for x in rows} == {"exact", "normalised", "ambiguous", "unresolved"}
    years = {r.report_id: r.year for r in Tables(spark, data).turn.collect()}
    assert len({years[r.report_id] for r in DOCUMENTS.plans["anchor_spans"](spark, data).collect()}) == len(set(years.values())) > 1


def test_marks_of_all_years_and_places(spark, data, made):
    words = ["rebate", "permit", "caregivers", "grant", "service standard"]
    for d in (data, made):
        kept, covered = set(), set()
        for r in Tables(spark, d).turn.where("text IS NOT NULL").collect():
            low = r.text.lower()
            spans = sorted((m.start(), m.start() + 20) for w in words for m in re.finditer(w, low) if m.start() + 20 <= len(r.text))
            pos, runs = 0, []
            for s, e in spans:
                if s >= pos:
                    kept.add((r.key, s, e))
                    pos = e
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            covered.update((r.key, s, e) for s, e in runs)
        assert kept and covered
        for name, expected in (("runs_from_spans", kept), ("cited_overlay", covered)):
            rows = [(r.key, r.s, r.e) for r in DOCUMENTS.plans[name](spark, d).collect()]
            assert len(rows) == len(set(rows)) and set(rows) == expected


def test_derive_constraints_of_every_text(spark, data, tmp_path):
    texts = [(1, "What was said between 1998 and 2001 on the Permit?"), (2, "The rebate of 2007."), (3, "A waiting list, no year."), (4, "Nothing named."), (5, "Between 2012 and 2010, and 2020"), (6, None), (7, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (data, str(tmp_path)):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").collect()}
        rows = TEXTS.plans["derive_constraints"](spark, d).collect()
        assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
        for r in rows:
            years = {int(y) for y in re.findall(r"\b(?:19|20)\d\d\b", docs[r.doc_id])}
            for a, b in re.findall(r"etween ((?:19|20)\d\d) and ((?:19|20)\d\d)", docs[r.doc_id]):
                years.update(range(min(int(a), int(b)), max(int(a), int(b)) + 1))
            subject = re.search(r"\b(take-up rate|waiting list|service standard|rebate|permit|grant)\b", docs[r.doc_id].lower())
            assert (r.years, r.subject) == (sorted(years), subject[1] if subject else "")


def test_chunks_of_any_part(spark, data):
    t = Tables(spark, data)
    texts = {r.key: r.text for r in t.turn.where("text IS NOT NULL").collect()}
    chunks = [r for r in t.chunk.where("cite_text IS NOT NULL").collect() if r.turn_key in texts]
    words = lambda x: set(re.findall("[a-z]{4,}", x.lower()))
    missing = [(r.id, r.missing) for r in DOCUMENTS.plans["evidence_missing"](spark, data).collect()]
    assert sorted(missing) == sorted((r.id, len(words(r.cite_text) - words(texts[r.turn_key]))) for r in chunks)
    places = [(r.id, r["at"], r.same) for r in DOCUMENTS.plans["provenance_check"](spark, data).collect()]
    assert sorted(places) == sorted((r.id, texts[r.turn_key].index(r.cite_text) + 1, True) for r in chunks if r.cite_text in texts[r.turn_key])
    assert {r.n_parts > 1 for r in chunks} == {r.part > 0 for r in chunks} == {True, False}
