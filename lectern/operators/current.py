"""The rows that hold, of tables whose rows are delivered more than once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources import load


def latest(rows: DataFrame, *keys: str, at: str = "loaded_at") -> DataFrame:
    """The row with the latest `at` for each key; null `at` counts as oldest. Equally late rows are taken to be equal."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last())
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


class Tables:
    """The domain's tables without redeliveries and duplicates, and the other tables as they are."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    @cached_property
    def turn(self) -> DataFrame:
        return latest(self.raw("turn"), "key")

    @cached_property
    def report(self) -> DataFrame:
        return latest(self.raw("report"), "report_id")

    @cached_property
    def chunk(self) -> DataFrame:
        return latest(self.raw("chunk"), "id")

    @cached_property
    def item(self) -> DataFrame:
        return self.raw("summary_item").distinct()

    @cached_property
    def link(self) -> DataFrame:
        return self.raw("summary_item_report").distinct()

    @cached_property
    def pair(self) -> DataFrame:
        return self.raw("supersession").distinct()


#: The same as common table expressions.
CURRENT_SQL = """
turn_ AS (SELECT * FROM turn QUALIFY row_number() OVER (PARTITION BY key ORDER BY loaded_at DESC NULLS LAST) = 1),
report_ AS (SELECT * FROM report QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY loaded_at DESC NULLS LAST) = 1),
chunk_ AS (SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1),
item_ AS (SELECT DISTINCT * FROM summary_item),
link_ AS (SELECT DISTINCT * FROM summary_item_report),
pair_ AS (SELECT DISTINCT * FROM supersession)
"""


def current_sql(body: str) -> str:
    """A query over the current tables; `body` starts with SELECT, or with a comma and more expressions."""
    return f"WITH {CURRENT_SQL}{body}"
