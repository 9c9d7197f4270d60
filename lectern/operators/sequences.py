"""Numbering, islands and folds over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources import checkpointed


def numbered(rows: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    """Rows numbered from 0 within each group."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def islands(rows: DataFrame, w: WindowSpec, breaks: Column, out: str) -> DataFrame:
    """Groups of neighbours: a row for which `breaks` holds begins a new one. Groups are numbered from 0."""
    rows = rows.withColumn("__b", F.coalesce(breaks, F.lit(False)).cast("int"))
    return rows.withColumn(out, F.sum("__b").over(w)).drop("__b")


def packed(rows: DataFrame, group: str, order: list[str], size: str, limit: int) -> DataFrame:
    """`group`, *order, `size`, bin of each row: bins of a group are filled in order, and a size that doesn't fit opens the next.

    Rows of a group pass one task in order, of which it keeps two numbers; a null size takes no room.
    """
    rows = rows.select(group, *order, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias(size))
    schema = T.StructType([*rows.schema.fields, T.StructField("bin", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bin_, used, begun = None, 0, 0, False
        for batch in batches:
            bins = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if not begun or g != now:
                    now, bin_, used, begun = g, 0, 0, True
                if used and used + n > limit:
                    bin_, used = bin_ + 1, 0
                used += n
                bins.append(bin_)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int32())], schema.names)

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def kept_spans(spans: Column) -> Column:
    """Of structs (s, e) in order of s, those that don't begin before the end of the last one kept."""
    empty = F.slice(spans, 1, 0)
    start = F.struct(empty.alias("kept"), F.lit(0).alias("pos"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["s"] >= acc["pos"]
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"), F.when(fits, x["e"]).otherwise(acc["pos"]).alias("pos"))

    return F.aggregate(spans, start, step)["kept"]


#: Rows of a group that are ordered in one task.
BLOCK = 4096


def carried_forward(rows: DataFrame, group: str, order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """`rows` with the last non-null value of each column up to each row, in the order of an integer column.

    A group is worked on in blocks by its order's number, of which each leaves one row to the next, so that a
    group that most rows are in is no single task's.
    """
    rows = rows.withColumn("__block", F.floor(F.col(order) / block))
    held = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"]
    last = rows.groupBy(group, "__block").agg(*(held(c).alias(f"__{c}") for c in columns))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = last.select(group, "__block", *(F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns))
    within = Window.partitionBy(group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(base, [group, "__block"])
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"__{c}")) for c in columns}).drop("__block", *(f"__{c}" for c in columns))


def running_total(rows: DataFrame, group: str, order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """The sum of `value` up to each row and with it, in the order of an integer column, by blocks as above."""
    rows = rows.withColumns({"__block": F.floor(F.col(order) / block), "__v": value})
    sums = rows.groupBy(group, "__block").agg(F.sum("__v").alias("__sum"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(base, [group, "__block"]).withColumn(out, F.col("__base") + F.coalesce(F.sum("__v").over(within), F.lit(0))).drop("__block", "__v", "__base")


def block_numbered(rows: DataFrame, group: str, order: str, out: str, block: int = BLOCK) -> DataFrame:
    """Rows numbered from 1 within each group in the order of an integer column without repeats, by blocks as above."""
    return running_total(rows, group, order, F.lit(1), out, block)


def neighbours(rows: DataFrame, group: str, order: str, columns: list[str], before: bool, block: int = BLOCK) -> DataFrame:
    """`rows` with __c of each column c: its value in the row just before (or after) in the order of an integer column,
    null at a group's end. By blocks, of which each gives its last (first) row to the next (one before)."""
    rows = rows.withColumn("__block", F.floor(F.col(order) / block))
    edge = F.struct(F.col(order).alias("o"), *(F.col(c).alias(c) for c in columns))
    ends = rows.groupBy(group, "__block").agg((F.max(edge) if before else F.min(edge)).alias("__edge"))
    by_block = Window.partitionBy(group).orderBy("__block")
    ends = ends.select(group, "__block", (F.lag("__edge") if before else F.lead("__edge")).over(by_block).alias("__near"))
    within = Window.partitionBy(group, "__block").orderBy(order)
    own = F.struct(*(F.col(c).alias(c) for c in columns))
    out = rows.join(ends, [group, "__block"]).withColumn("__own", (F.lag(own) if before else F.lead(own)).over(within))
    return out.withColumns({f"__{c}": F.when(F.col("__own").isNotNull(), F.col(f"__own.{c}")).otherwise(F.col(f"__near.{c}")) for c in columns}).drop("__block", "__own", "__near")


def ranked_by_range(rows: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Rows numbered from 1 within each group in an order that has no ties, whatever the group's size.

    Rows are divided by ranges of group and order, and written once as they lie; each range numbers its own, and begins
    where those before it in the group end.
    """
    laid = checkpointed(rows.repartitionByRange(group, *order).withColumn("__range", F.spark_partition_id()))
    counts = laid.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(group).alias("__group"), "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__range", group).orderBy(*order))
    j = laid.withColumn("__rn", within).join(base.withColumnRenamed("__range", "__r"), (F.col("__range") == F.col("__r")) & F.col("__group").eqNullSafe(F.col(group)))
    return j.withColumn(out, F.col("__base") + F.col("__rn")).drop("__range", "__r", "__group", "__base", "__rn")
