"""Data-quality gates: checks that count what breaks them, and fail on nothing to check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check_name, n_bad, n: how many rows break each check, in one pass. A check that is null for a row isn't broken."""
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in checks.items()))
    each = F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(k).alias("n_bad")) for k in checks))
    return counts.select("n", F.explode(each).alias("x")).select("x.check_name", "x.n_bad", "n")


def verdict(checks: DataFrame) -> DataFrame:
    """The checks with `passed`: nothing broken, and something there."""
    return checks.withColumn("passed", (F.col("n_bad") == 0) & (F.col("n") > 0))
