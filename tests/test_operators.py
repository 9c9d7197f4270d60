"""Folds, gates, ranking and sources against plain Python."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators.chunking import split_text
from lectern.operators.cover import greedy
from lectern.operators.gates import gate, verdict
from lectern.operators.ranking import bm25, cosine, fuse
from lectern.operators.sequences import block_numbered, carried_forward, kept_spans, neighbours, packed, ranked_by_range, running_total
from lectern.plans.documents import R as DOCUMENTS
from lectern.plans.documents import working_days_between
from lectern.sources import files
from lectern.sources.html import turns_of
from lectern.sources.paged import read_paged, sweep_coverage
from lectern.streaming import latest_by_key, new_files, session_counts, upsert_stream


def plain_split(text, limit, overlap, least):
    if len(text) <= limit:
        return [text]
    paras = [" ".join(p.split()) for p in re.split(r"\n{2,}", text)]
    paras = [p for p in paras if p]
    units = [p + " " if i < len(paras) - 1 else p for i, p in enumerate(paras)] if len(paras) > 1 else re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+$", text)
    out, cur = [], ""
    for u in units:
        if len(u) > limit:
            out += [cur] if cur else []
            out += [u[i : i + limit] for i in range(0, len(u), limit)]
            cur = ""
        elif len(cur) + len(u) <= limit:
            cur += u
        else:
            out += [cur] if cur else []
            cur = cur[-overlap:] + u if len(cur[-overlap:]) + len(u) <= limit else u
    if cur:
        if len(cur) < least and out:
            out[-1] += cur
        else:
            out.append(cur)
    return out


TEXTS = ["", "Short.", "One sentence here. " * 12, "A" * 130, "First para here.\n\nSecond para is a bit longer than it.\n\n" + "x" * 90 + "\n\nEnd.", "No end marks at all " * 9, "Tiny. " * 40]


def test_split_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").select("i", split_text("text", 60, 15, 8).alias("x"))
    assert {r.i: r.x for r in df.collect()} == {i: plain_split(t, 60, 15, 8) for i, t in enumerate(TEXTS)}


def test_packed(spark):
    rows = [("a", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 1])] + [("b", 0, 3), ("b", 1, None), (None, 0, 9), (None, 1, 9)]
    got = packed(spark.createDataFrame(rows, "g string, i int, n int"), "g", ["i"], "n", 10).collect()
    bins = {g: [r.bin for r in sorted(got, key=lambda r: r.i) if r.g == g] for g in ("a", "b", None)}
    assert bins == {"a": [0, 0, 1, 2, 3, 3], "b": [0, 0], None: [0, 1]}


def test_ranks_by_range(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(6), i) for i in range(500) for g in [rng.choice(["a", "a", "a", "b", None])]] + [("c", 1, 999)]
    got = ranked_by_range(spark.createDataFrame(rows, "g string, n int, i int").repartition(7), "g", [F.desc("n"), F.asc("i")], "rank").collect()
    for g in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [(r.n, r.i) for r in sorted((x for x in got if x.g == g), key=lambda x: x["rank"])] == [(n, i) for _, n, i in own]
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1, len(own) + 1))


@pytest.mark.parametrize("block", [2, 1000])
def test_sequences_by_blocks(spark, block):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, f"v{i}"]), rng.randrange(5)) for g in ("a", "b") for i in rng.sample(range(40), 23)] + [("c", 7, None, None)]
    df = spark.createDataFrame(rows, "g string, i int, v string, n int")
    got = running_total(carried_forward(df.withColumn("last", F.col("v")), "g", "i", ["last"], block), "g", "i", F.col("n"), "total", block)
    got = block_numbered(got, "g", "i", "rn", block)
    got = neighbours(neighbours(got.withColumn("x", F.col("i")), "g", "i", ["x", "v"], True, block).withColumnsRenamed({"__x": "px", "__v": "pv"}), "g", "i", ["x"], False, block)
    for g in ("a", "b", "c"):
        last, total, want = None, 0, []
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for k, (_, i, v, n) in enumerate(own):
            last, total = v or last, total + (n or 0)
            p, q = own[k - 1] if k else (None,) * 4, own[k + 1] if k + 1 < len(own) else (None,) * 4
            want.append((i, last, total, k + 1, p[1], p[2], q[1]))
        found = sorted((r.i, r["last"], r.total, r.rn, r.px, r.pv, r["__x"]) for r in got.where(F.col("g") == g).collect())
        assert found == want


def test_kept_spans(spark):
    df = spark.createDataFrame([([(0, 5), (3, 20), (5, 8), (7, 9), (8, 9)],), ([],)], "x array<struct<s:int,e:int>>")
    assert [[tuple(v) for v in r[0]] for r in df.select(kept_spans(F.col("x"))).collect()] == [[(0, 5), (5, 8), (8, 9)], []]


def test_gate_finds_each_planted_defect(spark):
    good = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("b", 1, 2)], "text string, part int, n int")
    checks = {"blank": F.trim("text") == "", "range": F.col("part") >= F.col("n")}
    assert all(r.passed for r in verdict(gate(good, checks)).collect())
    for bad, name in ((("", 0, 1), "blank"), (("a", 3, 1), "range")):
        rows = verdict(gate(good.union(spark.createDataFrame([bad], good.schema)), checks)).collect()
        assert [r.check_name for r in rows if not r.passed] == [name]
    assert not any(r.passed for r in verdict(gate(good.limit(0), checks)).collect())


def test_bm25_counts_query_words_twice_and_leaves_out_others(spark):
    docs = spark.createDataFrame([(1, "rebate rebate grant"), (2, "grant only"), (3, "nothing here"), (4, "")], "id int, text string")
    once = {r.id: r.score for r in bm25(docs, "id", "text", ["rebate", "grant"]).collect()}
    twice = {r.id: r.score for r in bm25(docs, "id", "text", ["rebate", "grant", "grant"]).collect()}
    assert set(once) == {1, 2} and once[1] > once[2]
    assert twice[2] == pytest.approx(2 * once[2])


def test_fusion_and_cosine(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    assert {r.k: r.score for r in fuse([a, b], "k").collect()} == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61)}
    v = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1.0), 0.0]


def test_greedy_cover(spark):
    rows = spark.createDataFrame([("g", "m1", "a"), ("g", "m1", "b"), ("g", "m2", "b"), ("g", "m3", "c"), ("h", "m1", "a")], "g string, m string, e string")
    assert sorted(map(tuple, greedy(rows, "g", "m", "e", 5).collect())) == [("g", "m1", 0, 2), ("g", "m3", 1, 1), ("h", "m1", 0, 1)]


def test_html():
    page = "<nav>x</nav><h6>2.03 pm</h6><p><b>Mr A</b>: One<p>two &amp; three<script>var s = '</p>';</script><p><strong>Ms B:</strong> Four"
    assert turns_of(page) == [("2.03 pm", "Mr A", "One\ntwo & three"), ("2.03 pm", "Ms B", "Four")]
    assert turns_of("") == turns_of(None) == []
    assert turns_of(page, "\n\n")[0][2] == "One\n\ntwo & three"


def test_paged_source(spark, tmp_path):
    row = lambda n: {"report_id": f"r-{n}", "title": f"T{n}", "report_type": None}
    pages = {
        "d1/oral": [[row(n) for n in range(20)], {str(n): row(n) for n in range(20, 25)}], "d1/bill": [[row(n) for n in range(20)], [row(n) for n in range(20)], [row(99)] * 20], "d2/oral": ["not rows"],
        "d2/written": [{"rows": [row(n) for n in range(20)]}, None],
    }
    for where, payloads in pages.items():
        (tmp_path / where).mkdir(parents=True)
        for n, x in enumerate(payloads):
            (tmp_path / where / f"page-{n}.json").write_text("{broken" if x is None else json.dumps(x))
    rows = read_paged(spark, str(tmp_path))
    counts = {(r.day, r.section): r["count"] for r in rows.groupBy("day", "section").count().collect()}
    assert counts == {("d1", "oral"): 25, ("d1", "bill"): 20, ("d2", "written"): 20}
    assert read_paged(spark, str(tmp_path), days="d1", sections="oral, bill").select("report_id").distinct().count() == 25
    said = spark.createDataFrame([("d1", 25), ("d2", 40), ("d3", 0), ("d4", None)], "day string, announced int")
    assert {r.day: r.ratio for r in sweep_coverage(rows, said).collect()} == {"d1": 1.0, "d2": 0.5, "d3": None, "d4": None}


def test_cached_table(spark, tmp_path):
    made = []
    compute = lambda: made.append(1) or spark.range(len(made))
    for refresh, n in ((False, 1), (False, 1), (True, 2)):
        assert files.cached_table(spark, str(tmp_path / "c"), compute, refresh).count() == n
    assert len(made) == 2 and "probed_at" in files.cached_table(spark, str(tmp_path / "c"), compute).columns


def test_sharded_json(spark, tmp_path):
    for y, body in ((2019, json.dumps({"date": "2019-01-02", "reports": [{"report_id": "r-1", "turns": [{"speaker": "A", "text": "x"}, {"text": "y"}]}]})), (2020, "{broken")):
        (tmp_path / f"year={y}").mkdir()
        (tmp_path / f"year={y}" / "a.json").write_text(body)
    good, bad = files.read_sittings(spark, str(tmp_path))
    assert [(r.key, r.speaker, r.text) for r in files.sitting_turns(good).collect()] == [("r-1#t0", "A", "x"), ("r-1#t1", None, "y")]
    assert bad.count() == 1
    assert files.read_sittings(spark, str(tmp_path), [2019])[1].count() == 0


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        files.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert files.migrate_partitioned(spark.range(6).selectExpr("id", "id % 2 AS p"), str(tmp_path / "p"), "p") == 6
    files.write_jsonl(spark.range(2), str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), spark.range(1).schema).count() == 2
    for _ in range(2):
        files.append_log(spark.range(2), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_a_replacement_may_stop_at_any_step(spark, tmp_path):
    for n in range(6):
        path = str(tmp_path / f"t{n}")
        files.replace_table(spark.range(3), path)
        spark.range(5).write.parquet(f"{path}.staged")
        for step in files.swap_steps(spark, f"{path}.staged", path, f"{path}.old")[:n]:
            step()
        assert files.read_table(spark, path, spark.range(1).schema).count() in (3, 5)
        files.replace_table(spark.range(7), path)
        assert spark.read.parquet(path).count() == 7


def test_a_merge_may_stop_at_any_step(spark, tmp_path):
    schema = "k string, at int, v string"
    first = spark.createDataFrame([(f"k{i}", 1, "a") for i in range(5)], schema)
    more = spark.createDataFrame([("k1", 2, "b"), ("k7", 2, "b"), ("k2", 0, "late"), ("k8", None, None), ("k1", 2, "b")], schema)
    want = sorted([("k0", 1, "a"), ("k1", 2, "b"), ("k2", 1, "a"), ("k3", 1, "a"), ("k4", 1, "a"), ("k7", 2, "b"), ("k8", None, None)])
    total = 1
    for n in range(0, 40):
        path = str(tmp_path / f"m{n}")
        files.merge_table(first, path, "k", "at", 3)
        steps = files.merge_steps(more, path, "k", "at", 3)
        total = len(steps)
        for step in steps[:n]:
            step()
        keys = {r.k for r in files.read_table(spark, path, first.schema).collect()}
        assert {f"k{i}" for i in range(5)} <= keys
        files.merge_table(more, path, "k", "at", 3)
        assert sorted(tuple(r) for r in files.read_table(spark, path, first.schema).collect()) == want
        if n > total:
            break
    assert files.read_table(spark, str(tmp_path / "none"), first.schema).count() == 0


def test_a_migration_is_planned_and_verified(spark, tmp_path):
    flat = str(tmp_path / "flat")
    spark.range(6).selectExpr("id", "id % 2 AS p").write.parquet(flat)
    rows = spark.read.parquet(flat)
    assert sorted(tuple(r) for r in files.migration_plan(rows, "p").collect()) == [(0, 3), (1, 3)]
    assert files.migrate_partitioned(rows, str(tmp_path / "by"), "p", delete=flat) == 6
    assert not (tmp_path / "flat").exists() and spark.read.parquet(str(tmp_path / "by")).count() == 6


def test_streams(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = new_files(spark, str(tmp_path / "in"), events, 1)
    upsert_stream(stream, str(tmp_path / "out"), "user_id", "ts", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("user_id").distinct().count()
    for name, df, mode in (("sessions", session_counts(stream), "append"), ("first", latest_by_key(stream, "event_id", "ts"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() > 0


def test_working_days_between(spark):
    first = dt.date(2024, 1, 1)
    pairs = [(first + dt.timedelta(a), first + dt.timedelta(a + n)) for a in range(9) for n in (-3, 0, 1, 2, 5, 6, 7, 13, 40)]
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", working_days_between(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        assert r.n == sum((r.a + dt.timedelta(k)).weekday() < 5 for k in range(1, (r.b - r.a).days + 1))


def test_pieces_that_come_again_are_found_in_order(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    text = "So it is. " * 40
    chunks = [("a", "k", 0, text[:100]), ("b", "k", 1, text[80:200]), ("c", "k", 2, text[180:400]), ("d", "g", 0, text[:100]), ("e", "g", 1, "and " + text[:50]), ("f", "h", 0, "x" * 10), ("g", "h", 1, "z" * 60)]
    turns = [("k", text), ("g", text), ("h", "x" * 10 + "y" * 60 + "z" * 60)]
    spark.createDataFrame([(k, t, at) for k, t in turns], "key string, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/turn.parquet")
    spark.createDataFrame([(*c, at) for c in chunks], "id string, turn_key string, part int, cite_text string, loaded_at timestamp").write.parquet(f"{tmp_path}/chunk.parquet")
    got = {r.turn_key: (r.pieces, r.gaps, r.strange) for r in DOCUMENTS.plans["chunk_gap_check"](spark, str(tmp_path)).collect()}
    assert got == {"k": (3, 0, 0), "g": (1, 0, 1), "h": (2, 1, 0)}
