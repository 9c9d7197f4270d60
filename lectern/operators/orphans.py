"""References to records that are missing, withdrawn or loaded only later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.keys import key_form
from lectern.operators.bloom import BROADCAST_BYTES, bloom_segments, maybe_in, segments_for


def parent_states(parents: DataFrame, key: str) -> DataFrame:
    """One row for each key in its compared form: when it came first, and whether the row that holds is withdrawn.

    Of rows of one key that with the latest loaded_at holds; of equally late ones a withdrawn one does.
    Rows without loaded_at count as the oldest.
    """
    old = F.to_timestamp(F.lit("0001-01-01 00:00:00"))
    return (
        parents.select(key_form(key).alias("__key"), "loaded_at", "deleted_at")
        .where(F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(
            F.min("loaded_at").alias("__first"),
            F.max(F.struct(F.coalesce("loaded_at", old), F.col("deleted_at").isNotNull().alias("gone")))["gone"].alias("__gone"),
        )
    )


def references(rows: DataFrame, table: str, key: str, ref: str) -> DataFrame:
    """src_table, src_key, ref_key (as stored), loaded_at and the compared form of each non-null reference."""
    return rows.where(F.col(ref).isNotNull()).select(
        F.lit(table).alias("src_table"),
        F.col(key).alias("src_key"),
        F.col(ref).alias("ref_key"),
        F.col("loaded_at"),
        key_form(ref).alias("__key"),
    )


def orphan_references(refs: DataFrame, parents: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each reference without valid target, once: src_table, src_key, ref_key, kind, period.

    A Bloom filter of the parents' keys proves most dangling references; only the rest go through the
    exact join with the parents' states. The filter is broadcast up to `broadcast_bytes`, and beyond that
    references meet its segments by a shuffle. Its size follows from the number of parent rows, which is
    counted first, from the files' footers. kind is `missing`, `deleted` or `late`, in this order of
    precedence. A reference that is empty or blank is missing; one without loaded_at is never late and has a
    null period. No parents: all are missing.
    """
    n_segments = segments_for(parents.count())
    bits = bloom_segments(parents.select(key_form(key).alias("__key")), "__key", n_segments)
    marked = maybe_in(refs, "__key", bits, n_segments, broadcast_bytes=broadcast_bytes)
    sure = marked.where(~F.col("maybe")).withColumn("kind", F.lit("missing"))
    states, open_ = parent_states(parents, key), marked.where("maybe")
    checked = (
        open_.join(states, "__key", "left")
        .withColumn(
            "kind",
            F.when(F.col("__gone").isNull(), "missing").when(F.col("__gone"), "deleted").when(F.col("__first") > F.col("loaded_at"), "late"),
        )
        .where("kind IS NOT NULL")
    )
    cols = ["src_table", "src_key", "ref_key", "kind", F.date_format("loaded_at", "yyyy-MM").alias("period")]
    return sure.select(*cols).unionByName(checked.select(*cols)).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans by table, month and kind: the number of references and of distinct keys referred to."""
    return found.groupBy("src_table", "period", "kind").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
