"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.keys import key_form, title_form


def signed_cells(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(snapshot_no, key, field, value, sign): what a snapshot holds counts +1 in it and -1 in the next one.

    `rows` has snapshot_no, next_no (null in the last), key and the string columns `fields`; a null value
    differs from every other. The field `` marks that the key is there.
    """
    cell = lambda f: F.struct(F.lit(f).alias("field"), (F.col(f) if f else F.lit(None).cast("string")).alias("value"))
    at = F.array(F.struct(F.col("snapshot_no").alias("no"), F.lit(1).alias("sign")), F.struct(F.col("next_no").alias("no"), F.lit(-1).alias("sign")))
    return (
        rows.select("key", F.explode(at).alias("at"), F.array(*map(cell, ["", *fields])).alias("cells"))
        .where("at.no IS NOT NULL")
        .select(F.col("at.no").alias("snapshot_no"), "key", F.col("at.sign").alias("sign"), F.explode("cells").alias("cell"))
        .select("snapshot_no", "key", "cell.field", "cell.value", "sign")
    )


def snapshot_changes(rows: DataFrame, fields: list[str]) -> DataFrame:
    """snapshot_no, key, change (`added`, `removed`, `changed`) and, of changed ones, changed_fields.

    `rows` has one row for each (snapshot_no, key). Snapshots follow each other by number, gaps in the
    numbers allowed; the first has no changes. Sums of signed cells that aren't zero are the differences.
    """
    numbers = rows.select("snapshot_no").where("snapshot_no IS NOT NULL").distinct()
    # one row a snapshot: a history of deliveries, not of records
    order = numbers.select("snapshot_no", F.lead("snapshot_no").over(Window.orderBy("snapshot_no")).alias("next_no"), F.lag("snapshot_no").over(Window.orderBy("snapshot_no")).alias("prior_no"))
    # cells of one key meet once: by key, which serves the sums of both levels
    sums = signed_cells(rows.join(order, "snapshot_no").repartition("key"), fields).groupBy("snapshot_no", "key", "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    presence = F.max(F.when(F.col("field") == "", F.col("n")))
    return (
        sums.groupBy("snapshot_no", "key")
        .agg(presence.alias("p"), F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("changed_fields"))
        .join(order.where("prior_no IS NOT NULL").select("snapshot_no"), "snapshot_no", "left_semi")
        .select("snapshot_no", "key", F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed").alias("change"), F.when(F.col("p").isNull(), F.col("changed_fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"))
    )


def latest_of_snapshot(rows: DataFrame, key: Column, values: dict[str, Column], at: str) -> DataFrame:
    """The row with the latest `at` for each (snapshot_no, key); of equally late ones that with the largest values."""
    packed = F.struct(F.col(at).alias("__at"), *(v.alias(k) for k, v in values.items()))
    return (
        rows.select("snapshot_no", key.alias("key"), packed.alias("r"))
        .where("key IS NOT NULL AND snapshot_no IS NOT NULL")
        .groupBy("snapshot_no", "key")
        .agg(F.max("r").alias("r"))
        .select("snapshot_no", "key", *(F.col(f"r.{k}").alias(k) for k in values))
    )


def report_snapshot_changes(snapshots: DataFrame, reports: DataFrame) -> DataFrame:
    """snapshot_no, report_id (in its form in `reports`, else in the compared form), change, changed_fields.

    Compared are the title, regardless of case and blanks, and the sequence of turn hashes, regardless
    of case. A null title or sequence is a value of its own.
    """
    values = {
        "title": title_form("title"),
        "turns": F.md5(F.lower(F.array_join(F.col("turn_hashes"), ",", "?"))),
    }
    rows = latest_of_snapshot(snapshots, key_form("report_id"), values, "delivered_at")
    changes = snapshot_changes(rows, list(values))
    known = reports.where("report_id IS NOT NULL").groupBy(key_form("report_id").alias("key")).agg(F.min(F.trim("report_id")).alias("report_id"))
    return changes.join(known, "key", "left").select("snapshot_no", F.coalesce("report_id", "key").alias("report_id"), "change", "changed_fields")
