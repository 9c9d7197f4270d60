"""Plans without SQL against brute force on the smallest tables."""

import hashlib
import json
import re
import unicodedata

from pyspark.sql import functions as F

from lectern.functions.text import MARKS_FROM, MARKS_TO
from lectern.operators.current import Tables
from lectern.plans.documents import R as DOCUMENTS
from lectern.plans.forms import R as FORMS
from lectern.plans.retrieval import R as RETRIEVAL
from lectern.plans.rules import R as RULES
from lectern.plans.texts import R as TEXTS
from lectern.plans.texts import pages, sentence_rows
from lectern.sources.html import turns_of
from test_operators import plain_split


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def turns(spark, data):
    return Tables(spark, data).turn.collect()


def test_near_duplicates(spark, data):
    first: dict = {}
    copies: dict = {}
    for r in sentence_rows(Tables(spark, data)).collect():
        words = frozenset(re.findall(r"[a-z]{4,}", r.s.lower()))
        if len(words) >= 3:
            k = (r.report_id, words)
            copies[k] = copies.get(k, 0) + 1
            first[k] = min(first.get(k, (r.turn, r.i, r.key)), (r.turn, r.i, r.key))
    expected = set()
    for (rid, w), f in first.items():
        repeats = any(o == rid and g < f and len(w & v) >= 0.75 * min(len(w), len(v)) for (o, v), g in first.items() if v != w)
        expected.add((rid, f[2], f[1], copies[rid, w], repeats))
    got = [(r.report_id, r.key, r.i, r.copies, r.repeats_earlier) for r in TEXTS.plans["near_duplicates"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert any(x[4] for x in expected)


def test_chunk_split(spark, data):
    expected = {(r.key, n, len(p), md5(p)) for r in turns(spark, data) if r.text for n, p in enumerate(plain_split(r.text, 6000, 800, 40))}
    assert {(r.key, r.part, r.n, r.piece_md5) for r in DOCUMENTS.plans["chunk_split"](spark, data).collect()} == expected


def test_norm_map(spark, data):
    table = str.maketrans(MARKS_FROM, MARKS_TO)
    expected = set()
    for r in turns(spark, data):
        if r.text:
            flat = [" " if re.match(r"[ \t\n\x0b\f\r]", c) else c for c in r.text.translate(table)]
            kept = [(c, i) for i, c in enumerate(flat) if not (c == " " and (i == 0 or flat[i - 1] == " "))]
            expected.add((r.key, md5("".join(c for c, _ in kept)), len(kept), kept[-1][1] if kept else None))
    assert {tuple(r) for r in TEXTS.plans["norm_map"](spark, data).collect()} == expected


def test_json_recover(spark, data):
    got = {r.event_id: r.k for r in RULES.plans["json_recover"](spark, data).collect()}
    assert got == {r.event_id: json.loads(r.props)["k"] for r in spark.read.parquet(f"{data}/events.parquet").collect()}


def test_derive_constraints(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").collect()}
    rows = TEXTS.plans["derive_constraints"](spark, data).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        years = {int(y) for y in re.findall(r"\b(?:19|20)\d\d\b", texts[r.doc_id])}
        for a, b in re.findall(r"etween ((?:19|20)\d\d) and ((?:19|20)\d\d)", texts[r.doc_id]):
            years.update(range(min(int(a), int(b)), max(int(a), int(b)) + 1))
        assert r.years == sorted(years)


def test_stratified_sample(spark, data):
    rows = DOCUMENTS.plans["stratified_sample"](spark, data).collect()
    assert len({r.key for r in rows}) == len(rows)
    per: dict = {}
    for r in rows:
        per.setdefault((r.group_name, r.slice), []).append(r.key)
    assert all(len(v) <= (8 if k[1] == "random" else 4) for k, v in per.items())
    assert {tuple(r) for r in rows} == {tuple(r) for r in DOCUMENTS.plans["stratified_sample"](spark, data).collect()}


def test_greedy_cover_covers_with_gains(spark, data):
    for r in DOCUMENTS.plans["greedy_cover"](spark, data).where(F.col("gain") <= 0).collect():
        raise AssertionError(r)
    steps = DOCUMENTS.plans["greedy_cover"](spark, data).groupBy("item_id").agg(F.max("step").alias("m"), F.count("*").alias("n")).collect()
    assert all(s.m == s.n - 1 for s in steps)


def test_compare_forms(spark, data):
    t = Tables(spark, data)
    texts = {r.key: r.text for r in t.turn.collect()}
    form = lambda x: " ".join(unicodedata.normalize("NFKC", x or "").split())
    expected = {}
    for r in t.chunk.collect():
        if r.turn_key in texts:
            a, b = r.cite_text, texts[r.turn_key]
            exact = a is not None and b is not None and a in b
            expected[r.id] = "exact" if exact else "blanks_or_forms" if form(a) in form(b) else "different"
    got = {r.id: r.found for r in FORMS.plans["compare_forms"](spark, data).collect()}
    assert got == expected and "exact" in got.values()


def test_page_paragraphs(spark, data):
    html = {r.key: r.html for r in pages(Tables(spark, data)).collect()}
    expected = {(k, i, s, md5(b)) for k, page in html.items() for i, (_, s, b) in enumerate(turns_of(page, "\n\n"))}
    assert {(r.key, r.i, r.speaker, r.body_md5) for r in FORMS.plans["page_paragraphs"](spark, data).collect()} == expected


def test_suggestions(spark, data):
    found = {r.turn_key for r in RETRIEVAL.plans["constrained_retrieve"](spark, data).where("question = 0").collect()}
    expected = {(r.date, r.report_id, r.title) for r in Tables(spark, data).turn.collect() if r.key in found}
    rows = [tuple(r) for r in FORMS.plans["suggestions"](spark, data).collect()]
    assert set(rows) == expected and len(rows) == len(expected) and rows == sorted(rows)
