"""The languages of documents and of their sentences, by nearest centroids.

A sentence is a vector of letter n-grams weighted by term and inverse document frequency, of length one.
Each language has several centroids, found by clustering the sentences of a bounded sample of labelled
documents; the nearest by cosine gives the language, and a sentence that is near to none has none.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.sentences import units
from lectern.sources import checkpointed

# The languages and the notations of their labels.
NOTATIONS = {
    "en": "en eng english inggeris anglais",
    "zh": "zh zho chi cmn mandarin chinese cina hans hant",
    "ms": "ms msa may zsm malay melayu",
    "ta": "ta tam tamil",
    "id": "id ind in indonesian indonesia bahasa-indonesia",
}
LANGUAGES = list(NOTATIONS)
#: Buckets of n-grams, lengths of n-grams, centroids of a language.
BUCKET_BITS, GRAMS, CLUSTERS = 14, (1, 2, 3, 4), 6
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents and sentences of each language from which centroids are made: the bound of the sample.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES = 400, 800
#: Characters of a labelled document that are looked at for its first sentences.
SAMPLE_CHARS = 20_000
#: Characters of sentences that are counted at a time.
CHARS = 1 << 16
#: Sentences that are multiplied with the centroids at a time.
BLOCK = 64
#: Share of a language's own sentences that lie below the cosine from which its threshold is taken.
REJECTED = 0.002
#: A language's threshold as a share of that cosine.
SLACK = 0.5
#: A sentence whose cosine with the main language of its document is this near to the greatest is in that one.
CLOSE = 0.05


def label_language(c: Column) -> Column:
    """The language that a label names in any notation, longer codes included; null if it names none."""
    head = F.split(F.lower(F.trim(c)), r"[-_\s(]")[0]
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(head.isin(*names.split()) | F.lower(F.trim(c)).isin(*names.split()), F.lit(code)).otherwise(out)
    return F.when(F.lower(F.trim(c)).startswith("bahasa melayu"), F.lit("ms")).when(F.lower(F.trim(c)).startswith("bahasa indonesia"), F.lit("id")).otherwise(out)


_END = re.compile(r"[^\W\d_]\W*[.!?。！？．…]", re.U)
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[一-鿿㐀-䶿]")


def is_sentence(unit: str) -> bool:
    """Whether a unit is a whole sentence: it has letters and an end mark, or else more words than a heading."""
    if not _LETTERS.search(unit):
        return False
    if re.search(r"[.!?。！？．…]", unit):
        return True
    return len(_LETTERS.findall(unit)) >= 5 or len(_CJK.findall(unit)) >= 8


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x20000)] + [True])


def gram_keys(sentences: list[str]) -> np.ndarray:
    """sentence * BUCKETS + bucket of each letter n-gram of each sentence. The hash of an n-gram goes on from that of
    the n-gram one shorter."""
    text = "\0".join(f" {s.lower()} " for s in sentences)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sep = x == 0
    x = np.where(_letters()[np.minimum(x, 0x20000)], x, np.uint32(32))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | sep[1:] | sep[:-1]
    x, sep = x[keep], sep[keep]
    kind = np.int32 if len(sentences) * BUCKETS < 1 << 31 else np.int64
    start = (np.cumsum(sep) * BUCKETS).astype(kind)
    keys = []
    h, inside = np.zeros(len(x), np.uint32), ~sep
    for n in GRAMS:
        if n > len(x):
            break
        if n > 1:
            h, inside = h[:-1], inside[:-1] & ~sep[n - 1 :]
        h = (h ^ x[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        here = inside & (x != 32) if n == 1 else inside
        bucket = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
        keys.append((start[: len(h)] + bucket.astype(kind))[here])
    return np.concatenate(keys or [np.zeros(0, kind)])


def gram_counts(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, bucket, count) of the letter n-grams of each sentence, in order of sentence and bucket."""
    keys = gram_keys(sentences)
    keys.sort()
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    found = keys[at]
    return found // BUCKETS, found % BUCKETS, np.diff(np.r_[at, len(keys)])


class Model(NamedTuple):
    """idf by bucket; the centroids' columns, their languages (-1 for a column of nobody), and each language's least cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    owners: np.ndarray
    least: np.ndarray

    def cosines(self, sentences: list[str]) -> np.ndarray:
        """The greatest cosine with a centroid of each language, a row for each sentence; 0 for one without letters."""
        out = np.zeros((len(sentences), len(LANGUAGES)), np.float32)
        s, b, n = gram_counts(sentences)
        if not len(s):
            return out
        w = n.astype(np.float32) * self.idf[b]
        norm = np.sqrt(np.bincount(s, w * w, len(sentences)))
        place = np.zeros(BUCKETS, np.int32)
        # two tables that are used again for each block of sentences
        room, rows = np.empty(BLOCK * BUCKETS, np.float32), np.empty(self.centroids.shape, np.float32)
        owned = [np.flatnonzero(self.owners == k) for k in range(len(LANGUAGES))]
        ends = np.searchsorted(s, np.arange(0, len(sentences) + BLOCK, BLOCK))
        for i, lo, hi in zip(range(0, len(sentences), BLOCK), ends, ends[1:]):
            here = b[lo:hi]
            used = np.flatnonzero(np.bincount(here, minlength=BUCKETS))
            place[used] = np.arange(len(used), dtype=np.int32)
            n = min(BLOCK, len(sentences) - i)
            x = room[: n * len(used)]
            x.fill(0)
            x[(s[lo:hi] - i) * np.int32(len(used)) + place[here]] = w[lo:hi]
            sums = x.reshape(n, len(used)) @ np.take(self.centroids, used, axis=0, out=rows[: len(used)])
            for k, own in enumerate(owned):
                if len(own):
                    out[i : i + n, k] = sums[:, own[0] : own[-1] + 1].max(axis=1)
        return out / np.maximum(norm, 1e-12)[:, None].astype(np.float32)


def _chunks(sentences: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for s in sentences:
        if held and size + len(s) > CHARS:
            yield held
            held, size = [], 0
        held.append(s)
        size += len(s)
    if held:
        yield held


def _some_sentences(text: str) -> list[str]:
    """Two sentences of a text's first SAMPLE_CHARS characters, those that come first by a hash: from anywhere in it,
    as openings are more alike than what follows."""
    text = text[:SAMPLE_CHARS]
    found = {x for a, b in units(text) if is_sentence(x := text[a:b])}
    return sorted(found, key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass")), x))[:2]


_SCANNED = T.StructType(
    [
        *(T.StructField(c, t) for c, t in (("b", T.IntegerType()), ("n", T.LongType()), ("lang", T.StringType()), ("h", T.LongType()), ("doc_id", T.LongType()))),
        T.StructField("s", T.ArrayType(T.StringType())),
    ]
)


def scan(documents: DataFrame, per_language: int, seed: int) -> tuple[np.ndarray, int, dict[str, list[str]]]:
    """In how many documents each bucket occurs, over all documents, their number, and sample sentences by label.

    All in one pass. Each task gives one vector of BUCKETS counts, whatever it reads, and of each language the
    `per_language` labelled documents that come first by a hash of their id, as two sentences each; of those
    the first of all tasks are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(BUCKETS, np.int64), 0
        held: dict[str, list[tuple[int, int, str]]] = {k: [] for k in LANGUAGES}
        for batch in batches:
            docs, texts, labels, hashes = (c.to_pylist() for c in batch.columns)
            for d, t, k, h in zip(docs, texts, labels, hashes):
                if k in held and t and d is not None:
                    # a heap with the latest of the hashes on top
                    (heapq.heappush if len(held[k]) < per_language else heapq.heappushpop)(held[k], (-h, -d, t[:SAMPLE_CHARS]))
            some = [t for t in texts if t and not t.isspace()]
            total += len(some)
            for chunk in _chunks(some):
                keys = gram_keys(chunk)
                seen = np.zeros(len(chunk) * BUCKETS, bool)
                seen[keys] = True
                df += seen.reshape(len(chunk), BUCKETS).sum(axis=0)
        b = np.flatnonzero(df)
        rows = [(None, None, k, -h, -d, _some_sentences(t)) for k, x in held.items() for h, d, t in x]
        cols = list(zip(*rows)) or [()] * 6
        none = [None] * (len(b) + 1)
        types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        data = [[*b.tolist(), -1, *cols[0]], [*df[b].tolist(), total, *cols[1]], *([*none, *c] for c in cols[2:])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types)], _SCANNED.names)

    rows = documents.select(F.col("doc_id").cast("long"), "text", label_language(F.col("lang")), F.xxhash64("doc_id", F.lit(seed))).mapInArrow(run, _SCANNED)
    rows = checkpointed(rows)
    counts = rows.where("b IS NOT NULL").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    real = counts["b"] >= 0
    df[counts.loc[real, "b"].to_numpy()] = counts.loc[real, "n"]
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    sample = rows.where("b IS NULL").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_language).orderBy("lang", "rn").select("lang", "s").collect()
    return df, int(counts.loc[~real, "n"].sum()), {k: [x for r in sample if r.lang == k for x in r.s] for k in LANGUAGES}


def _vectors(sentences: list[str], idf: np.ndarray) -> np.ndarray:
    s, b, n = gram_counts(sentences)
    out = np.zeros((len(sentences), BUCKETS), np.float32)
    out[s, b] = n * idf[b]
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
    return out


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length one, begun from sentences at even distances in the sample."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _without_itself(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each sentence's greatest cosine with the centroids, its own made without it: what a sentence not in the sample gets."""
    cos = x @ c.T
    own = cos.argmax(axis=1)
    sums = np.stack([x[own == j].sum(axis=0) for j in range(len(c))])
    along = (x * sums[own]).sum(axis=1)
    rest = np.sqrt(np.maximum((sums**2).sum(axis=1)[own] - 2 * along + 1, 0))
    cos[np.arange(len(x)), own] = np.where(rest > 1e-6, (along - 1) / np.maximum(rest, 1e-6), 0)
    return cos.max(axis=1)


def fit(samples: dict[str, list[str]], df: np.ndarray, total: int, clusters: int = CLUSTERS) -> Model:
    """Centroids from sentences by label. Labels may be wrong for a minority: a sentence is left out if the
    sentences most like it, as a share of their label's sample, mostly have another label; so wrongly
    labelled ones lose to their own kind."""
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    names = [k for k in LANGUAGES if samples.get(k)]
    ends = np.cumsum([0] + [len(samples[k][:SAMPLE_SENTENCES]) for k in names])
    every = _vectors([x for k in names for x in samples[k][:SAMPLE_SENTENCES]], idf)
    xs = {k: every[a:b] for k, a, b in zip(names, ends, ends[1:])}
    kept = {}
    if names:
        like = every @ every.T
        np.maximum(like, 0, out=like)
        like *= like
        np.fill_diagonal(like, 0)
        weight = np.add.reduceat(like, ends[:-1], axis=1) / np.diff(ends)
        del like
        for j, k in enumerate(names):
            right = weight[ends[j] : ends[j + 1]].argmax(axis=1) == j
            kept[k] = right if right.any() else np.ones(len(right), bool)
    found = {k: _clusters(xs[k][kept[k]], clusters) for k in names}
    c = np.concatenate([found[k] for k in names]) if names else np.zeros((0, BUCKETS), np.float32)
    owners = np.concatenate([np.full(len(found[k]), LANGUAGES.index(k)) for k in names]) if names else np.zeros(0, np.int64)
    least = np.full(len(LANGUAGES), 2.0)
    for k in names:
        least[LANGUAGES.index(k)] = SLACK * np.quantile(_without_itself(xs[k][kept[k]], found[k]), REJECTED)
    # columns of nobody up to a number that multiplies fast
    more = -len(c) % 16
    c = np.concatenate([c, np.zeros((more, BUCKETS), np.float32)])
    return Model(idf, np.ascontiguousarray(c.T.astype(np.float32)), np.r_[owners, np.full(more, -1)], least)


def train(documents: DataFrame, per_language: int = SAMPLE_DOCUMENTS, seed: int = 7) -> Model:
    """A model from at most `per_language` labelled documents of each language, picked by a hash of their id."""
    df, total, samples = scan(documents, per_language, seed)
    return fit(samples, df, total)


def read_languages(sentences: list[str], model: Model, owner: list[int] | None = None) -> tuple[list[str | None], list[float]]:
    """The language of each sentence, or none, and how sure that is (0 to 1).

    `owner` says which document each sentence is of, by number; without it all are of one. The confidence
    is the lead over the next language as a share of the greatest cosine. A sentence that is nearly as close
    to the language of most of its document takes that; its confidence is 0 then, as another is nearer.
    """
    if not sentences:
        return [], []
    cos = np.concatenate([model.cosines(c) for c in _chunks(sentences)])
    of = np.zeros(len(cos), np.int64) if owner is None else np.asarray(owner)
    rows = np.arange(len(cos))
    best = cos.argmax(axis=1)
    top = cos[rows, best]
    accepted = top >= model.least[best]
    weight = np.bincount(of * len(LANGUAGES) + best, np.where(accepted, _lead(cos, best), 0), (of.max() + 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    main = weight.argmax(axis=1)[of]
    swap = accepted & (weight.max(axis=1)[of] > 0) & (cos[rows, main] >= (1 - CLOSE) * top)
    best = np.where(swap, main, best)
    sure = np.where(accepted, _lead(cos, best), 0.0).round(4)
    return [LANGUAGES[b] if a else None for b, a in zip(best, accepted)], [float(x) for x in sure]


def _lead(cos: np.ndarray, of: np.ndarray) -> np.ndarray:
    """By how much a language's cosine leads all others', as a share of the greatest; 0 if it doesn't."""
    rows = np.arange(len(cos))
    others = cos.copy()
    others[rows, of] = -1
    return np.maximum(cos[rows, of] - others.max(axis=1), 0) / np.maximum(cos.max(axis=1), 1e-12)


class Read(NamedTuple):
    """The whole sentences of a batch of documents: whose each is, its place, language and confidence."""

    owner: list[int]
    spans: list[tuple[int, int]]
    langs: list[str | None]
    sure: list[float]


def read_batch(texts: list[str | None], model: Model) -> Read:
    spans = [(n, a, b) for n, text in enumerate(texts) for a, b in units(text) if is_sentence(text[a:b])]
    owner = [n for n, _, _ in spans]
    return Read(owner, [(a, b) for _, a, b in spans], *read_languages([texts[n][a:b] for n, a, b in spans], model, owner))


def _by_document(documents: DataFrame, schema: T.StructType, types: list[pa.DataType], rows_of: Callable[[list, list, list, Read], Iterator[tuple]], model: Model) -> DataFrame:
    """What a function gives for each batch of (doc_id, text, language of the label). A document is one row, so
    nothing of it is elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, labels = (c.to_pylist() for c in batch.columns)
            cols = list(zip(*rows_of(docs, texts, labels, read_batch(texts, model)))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], schema.names)

    return documents.select(F.col("doc_id").cast("long"), "text", label_language(F.col("lang"))).mapInArrow(run, schema)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def sentence_languages(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, char_start, char_end, lang, confidence of each whole sentence; lang is null where it is near to no language."""

    def rows_of(docs: list, texts: list, labels: list, r: Read) -> Iterator[tuple]:
        for n, (a, b), lang, sure in zip(r.owner, r.spans, r.langs, r.sure):
            yield docs[n], a, b, lang, sure

    schema = _fields(doc_id=T.LongType(), char_start=T.IntegerType(), char_end=T.IntegerType(), lang=T.StringType(), confidence=T.DoubleType())
    return _by_document(documents, schema, [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()], rows_of, model)


def document_languages(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, labelled, lang, langs, shares, confidence of each document with text in some language.

    `labelled` is the language its label names. langs are the languages in which it has a whole sentence, in
    order of how much text is in each, shares says how much; confidence is the sentences', weighted by length.
    `lang` is the first of langs. A document without a whole sentence, such as a heading, has no langs: its
    lang is that of its text as a whole, at half the confidence, if that is near enough to a language; else,
    as for null, empty and blank texts, it is left out. Rows that repeat a doc_id are read each.
    """

    def rows_of(docs: list, texts: list, labels: list, r: Read) -> Iterator[tuple]:
        sums: dict[int, dict[str, list[float]]] = {}
        for n, (a, b), lang, sure in zip(r.owner, r.spans, r.langs, r.sure):
            if lang is not None:
                x = sums.setdefault(n, {}).setdefault(lang, [0, 0.0])
                x[0] += b - a
                x[1] += (b - a) * sure
        rest = [n for n, t in enumerate(texts) if n not in sums and t and _LETTERS.search(t)]
        whole = dict(zip(rest, zip(*read_languages([texts[n] for n in rest], model, list(range(len(rest)))))))
        for n, (doc, label) in enumerate(zip(docs, labels)):
            if n in sums:
                order = sorted(sums[n].items(), key=lambda kv: (-kv[1][0], kv[0]))
                total = sum(v[0] for _, v in order)
                yield doc, label, order[0][0], [k for k, _ in order], [round(v[0] / total, 4) for _, v in order], round(sum(v[1] for _, v in order) / total, 4)
            elif n in whole and whole[n][0] is not None:
                yield doc, label, whole[n][0], [], [], round(whole[n][1] / 2, 4)

    strings, doubles = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())
    schema = _fields(doc_id=T.LongType(), labelled=T.StringType(), lang=T.StringType(), langs=strings, shares=doubles, confidence=T.DoubleType())
    return _by_document(documents, schema, [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()], rows_of, model)


def language_segments(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, segment, lang, char_start, char_end, confidence: runs of sentences in one language.

    Sentences in no language belong to the run around them; before the first run to none. The confidence is
    the sentences' mean.
    """

    def rows_of(docs: list, texts: list, labels: list, r: Read) -> Iterator[tuple]:
        run: list = []
        for n, (a, b), lang, sure in zip(r.owner, r.spans, r.langs, r.sure):
            if lang is None:
                continue
            if run and run[0] == n and run[2] == lang:
                run[4] = b
                run[5].append(sure)
                continue
            if run:
                yield docs[run[0]], *run[1:5], round(sum(run[5]) / len(run[5]), 4)
            run = [n, run[1] + 1 if run and run[0] == n else 0, lang, a, b, [sure]]
        if run:
            yield docs[run[0]], *run[1:5], round(sum(run[5]) / len(run[5]), 4)

    i = T.IntegerType()
    schema = _fields(doc_id=T.LongType(), segment=i, lang=T.StringType(), char_start=i, char_end=i, confidence=T.DoubleType())
    return _by_document(documents, schema, [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()], rows_of, model)


def wrong_labels(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang: a row for each language of a document that mixes languages, or whose label is missing,
    unknown or another language's than the document's. Only languages with a whole sentence count."""
    docs = document_languages(documents, model)
    right = (F.size("langs") == 1) & (F.col("labelled") == F.col("langs")[0])
    return docs.where(~F.coalesce(right, F.lit(False))).select("doc_id", F.explode("langs").alias("lang"))
