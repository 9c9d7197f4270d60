"""Orphans and snapshots on rows made to be hard."""

import datetime as dt

from lectern.functions.keys import key_form
from lectern.operators.bloom import SEGMENT_WORDS, bloom_segments, filter_bytes, maybe_in, segments_for
from lectern.operators.orphans import orphan_references, orphan_report, references
from lectern.operators.snapshots import report_snapshot_changes

D = lambda n: dt.datetime(2020, 1, n)
PARENT = "key string, loaded_at timestamp, deleted_at timestamp, maybe string, word string"
CHILD = "id string, ref string, loaded_at timestamp, kind string"


def found(spark, parents, children, **more):
    p = spark.createDataFrame(parents, PARENT)
    c = spark.createDataFrame(children, CHILD)
    return sorted((r.src_key, r.ref_key, r.kind, r.period) for r in orphan_references(references(c, "child", "id", "ref"), p, "key", **more).collect())


PARENTS = [("A#t1", D(1), None, "x", "x"), ("A#t1", D(5), D(6), "x", "x"), ("b", D(9), None, "x", "x"), ("b", D(9), None, "x", "x"), ("c", D(2), D(3), "x", "x"), ("c", D(8), None, "x", "x"), (None, D(1), None, "x", "x"), ("e", None, None, "x", "x")]
CHILDREN = [("1", " a#T1# ", D(7), "k"), ("2", "B", D(3), "k"), ("2", "B", D(3), "k"), ("3", "b", D(9), "k"), ("4", "C ", D(9), "k"), ("5", "zz", None, "k"), ("6", None, D(1), "k"), ("7", "", D(1), "k"), ("8", "e", D(1), "k"), ("9", "b", None, "k")]
EXPECTED = [("1", " a#T1# ", "deleted", "2020-01"), ("2", "B", "late", "2020-01"), ("5", "zz", "missing", None), ("7", "", "missing", "2020-01")]


def test_orphans(spark):
    assert found(spark, PARENTS, CHILDREN) == EXPECTED


def test_orphans_with_a_filter_too_large_for_a_broadcast_are_the_same(spark):
    assert found(spark, PARENTS, CHILDREN, broadcast_bytes=0) == EXPECTED


def test_every_size_goes_through_the_filter(spark):
    p = spark.createDataFrame(PARENTS, PARENT)
    refs = references(spark.createDataFrame(CHILDREN, CHILD), "child", "id", "ref")
    for limit in (0, 1 << 30):
        plan = orphan_references(refs, p, "key", broadcast_bytes=limit)._jdf.queryExecution().optimizedPlan().toString()
        assert "bit_or" in plan and ("__salt" in plan) == (limit == 0)


def test_orphans_of_empty_tables(spark):
    assert found(spark, [], CHILDREN[:2]) == [("1", " a#T1# ", "missing", "2020-01"), ("2", "B", "missing", "2020-01")]
    assert found(spark, PARENTS, []) == []
    assert orphan_report(orphan_references(references(spark.createDataFrame(CHILDREN, CHILD), "child", "id", "ref"), spark.createDataFrame([], PARENT), "key")).count() > 0


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    assert segments_for(0) == segments_for(1) == 1 and filter_bytes(segments_for(10_000_000)) < 11_000_000
    n_keys = 100_000
    keys = spark.range(n_keys).selectExpr("concat('k', id) AS k", "id AS v").unionByName(spark.createDataFrame([(None, 1)], "k string, v long"))
    other = spark.range(n_keys).selectExpr("concat('z', id) AS k", "id AS v")
    n = segments_for(n_keys)
    assert n > 1
    for segments, limit in ((n, 1 << 30), (n, 0), (1, 1 << 30)):
        table = bloom_segments(keys, "k", segments)
        assert all(len(r.words) <= SEGMENT_WORDS for r in table.collect())
        assert maybe_in(keys, "k", table, segments, broadcast_bytes=limit).where("k IS NOT NULL AND NOT maybe").count() == 0
        out = maybe_in(other, "k", table, segments, broadcast_bytes=limit)
        assert out.count() == n_keys and out.columns == ["k", "v", "maybe"]
        assert out.where("maybe").count() < (0.12 if segments == n else 0.5) * n_keys
    few = bloom_segments(keys.limit(3), "k", 7)
    assert maybe_in(other, "k", few, 7).where("maybe").count() < 0.01 * n_keys
    assert maybe_in(other, "k", bloom_segments(keys.limit(0), "k", 1), 1).where("maybe").count() == 0


def test_key_form(spark):
    rows = spark.createDataFrame([(" A-1#t2# ",), ("a-1#t2",), (" A-1#T2\n",), (None,), ("",)], "k string").select(key_form("k").alias("f")).collect()
    assert [r.f for r in rows] == ["a-1#t2", "a-1#t2", "a-1#t2", None, ""]


SNAP = "snapshot_no int, delivered_at timestamp, report_id string, title string, turn_hashes array<string>, key string, sign int"


def changes(spark, rows, reports=(("R-1",), ("R-2",))):
    s = spark.createDataFrame(rows, SNAP)
    r = spark.createDataFrame(list(reports), "report_id string")
    return sorted((x.snapshot_no, x.report_id, x.change, ",".join(x.changed_fields)) for x in report_snapshot_changes(s, r).collect())


def test_snapshot_changes(spark):
    row = lambda n, r, t, h, at=1: (n, D(at), r, t, h, "x", 1)
    rows = [
        row(1, "R-1", "One", ["aa"]), row(1, "R-2", "Two", ["b"]), row(1, "r-3", "T", []),
        row(2, "r-1 ", " one", ["AA"]), row(2, "R-2", "Two!", ["b", "c"]), row(2, "r-4", None, None),
        row(3, "R-1", "One", ["zz"], 1), row(3, "R-1", "One", ["aa"], 2), row(3, "r-4", None, []), row(3, None, "x", ["q"]),
    ]
    assert changes(spark, rows) == [(2, "R-2", "changed", "title,turns"), (2, "r-3", "removed", ""), (2, "r-4", "added", ""), (3, "R-2", "removed", ""), (3, "r-4", "changed", "turns")]


def test_snapshots_with_gap_in_numbers_and_empty_table(spark):
    rows = [(1, D(1), "R-1", "a", ["x"], "", 0), (5, D(1), "R-1", "b", ["x"], "", 0), (5, D(1), "R-1", "b", ["x"], "", 0)]
    assert changes(spark, rows) == [(5, "R-1", "changed", "title")]
    assert changes(spark, []) == []
