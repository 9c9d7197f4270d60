"""Rows that hold, and reports that are drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.keys import key_form


def holding(rows: DataFrame, key: str) -> DataFrame:
    """The row with the latest loaded_at for each key, with the compared form of the key as __key.

    Null loaded_at counts as oldest. Of equally late rows one is taken by a hash of all their columns, so
    the result doesn't depend on the order of rows. Rows without key are left out.
    """
    order = [F.col("loaded_at").desc_nulls_last(), F.xxhash64(*(F.col(c).cast("string") for c in rows.columns))]
    w = Window.partitionBy("__key").orderBy(*order)
    return (
        rows.withColumn("__key", key_form(key))
        .where(F.col("__key").isNotNull())
        .withColumn("__rn", F.row_number().over(w))
        .where("__rn = 1")
        .drop("__rn")
    )


def drafts(reports: DataFrame) -> DataFrame:
    """The compared keys (__report) of reports whose holding row is a draft."""
    kept = holding(reports.select("report_id", "report_version", "loaded_at"), "report_id")
    return kept.where(F.col("report_version") == "draft").select(F.col("__key").alias("__report"))


def by_draft(turns: DataFrame, reports: DataFrame, draft: bool) -> DataFrame:
    """Rows with report_id of draft reports, or of all others; a turn of no known report isn't a draft's."""
    return turns.withColumn("__report", key_form("report_id")).join(drafts(reports), "__report", "left_semi" if draft else "left_anti").drop("__report")
