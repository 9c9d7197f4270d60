"""Orphan references and snapshot changes over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.orphans import orphan_references, orphan_report, references
from lectern.operators.snapshots import report_snapshot_changes
from lectern.plans.registry import Registry
from lectern.sources import load

R = Registry()

_KEY = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]*#?[\s\p{{Z}}]*$', '', 'g'))"

_ORPHANS = f"""
WITH ref AS (
  SELECT 'summary_item_report' AS src_table, item_id AS src_key, report_id AS ref_key, loaded_at, 'report' AS parent FROM summary_item_report
  UNION ALL SELECT 'chunk', id, turn_key, loaded_at, 'turn' FROM chunk
  UNION ALL SELECT 'supersession', announce_turn, supersede_turn, loaded_at, 'turn' FROM supersession
), parent AS (
  SELECT 'report' AS parent, {_KEY.format('report_id')} AS k, loaded_at, deleted_at FROM report
  UNION ALL SELECT 'turn', {_KEY.format('key')}, loaded_at, deleted_at FROM turn
), state AS (
  SELECT parent, k, min(loaded_at) AS first_at,
         max(CASE WHEN deleted_at IS NOT NULL THEN 1 ELSE 0 END) FILTER (WHERE newest) AS gone
  FROM (SELECT *, loaded_at = max(loaded_at) OVER (PARTITION BY parent, k) AS newest FROM parent)
  GROUP BY 1, 2
), kinds AS (
  SELECT r.src_table, r.src_key, r.ref_key,
         CASE WHEN s.k IS NULL THEN 'missing' WHEN s.gone = 1 THEN 'deleted' WHEN s.first_at > r.loaded_at THEN 'late' END AS kind,
         strftime(r.loaded_at, '%Y-%m') AS period
  FROM ref r LEFT JOIN state s ON s.parent = r.parent AND s.k = {_KEY.format('r.ref_key')}
  WHERE r.ref_key IS NOT NULL
), found AS (SELECT DISTINCT * FROM kinds WHERE kind IS NOT NULL)
"""


@R.query("p4_found", _ORPHANS + "SELECT * FROM found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = references(load(spark, sf_dir, "summary_item_report"), "summary_item_report", "item_id", "report_id")
    chunk = references(load(spark, sf_dir, "chunk"), "chunk", "id", "turn_key")
    pair = references(load(spark, sf_dir, "supersession"), "supersession", "announce_turn", "supersede_turn")
    of_report = orphan_references(item, load(spark, sf_dir, "report"), "report_id")
    return of_report.unionByName(orphan_references(chunk.unionByName(pair), load(spark, sf_dir, "turn"), "key"))


@R.query("p4_report", _ORPHANS + "SELECT src_table, period, kind, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY 1, 2, 3")
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p4_found(spark, sf_dir))


_CHANGES = rf"""
WITH latest AS (
  SELECT snapshot_no, {_KEY.format('report_id')} AS k, lower(trim(regexp_replace(title, '[\s\p{{Z}}]+', ' ', 'g'))) AS title,
         lower(array_to_string(turn_hashes, ',')) AS turns
  FROM report_snapshot
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, {_KEY.format('report_id')} ORDER BY delivered_at DESC) = 1
), step AS (
  SELECT * FROM (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prior_no FROM (SELECT DISTINCT snapshot_no FROM report_snapshot))
  WHERE prior_no IS NOT NULL
), now AS (SELECT s.snapshot_no AS at, l.* FROM step s JOIN latest l ON l.snapshot_no = s.snapshot_no
), before AS (SELECT s.snapshot_no AS at, l.* FROM step s JOIN latest l ON l.snapshot_no = s.prior_no
), change AS (
  SELECT coalesce(a.at, b.at) AS snapshot_no, coalesce(a.k, b.k) AS k,
         CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM now a FULL JOIN before b ON a.at = b.at AND a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL OR a.title IS DISTINCT FROM b.title OR a.turns IS DISTINCT FROM b.turns
), known AS (SELECT {_KEY.format('report_id')} AS k, min(trim(report_id)) AS report_id FROM report GROUP BY 1)
SELECT c.snapshot_no, coalesce(r.report_id, c.k) AS report_id, c.change FROM change c LEFT JOIN known r USING (k)
"""


@R.query("p7_found", _CHANGES)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report_snapshot_changes(load(spark, sf_dir, "report_snapshot"), load(spark, sf_dir, "report"))
    return found.select("snapshot_no", "report_id", "change")


_FIELDS = _CHANGES.replace(
    """AS change
  FROM now a""",
    """AS change,
         CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.title IS DISTINCT FROM b.title THEN 'title' END, CASE WHEN a.turns IS DISTINCT FROM b.turns THEN 'turns' END) END AS changed_fields
  FROM now a""",
).replace("c.change FROM change c", "c.change, c.changed_fields FROM change c")


@R.query("p7_fields", _FIELDS)
def p7_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report_snapshot_changes(load(spark, sf_dir, "report_snapshot"), load(spark, sf_dir, "report"))
    return found.selectExpr("snapshot_no", "report_id", "change", "array_join(changed_fields, ',') AS changed_fields")
