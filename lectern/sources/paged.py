"""A source of pages: each day and section is read a page at a time, until there are no more rows."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a full page, and pages that are asked for at most.
PAGE, MOST_PAGES = 20, 200


def rows_of(payload: object) -> list[dict]:
    """The rows of a page, which holds them as a list or as an object keyed by number; none for anything else."""
    if isinstance(payload, dict):
        payload = payload.get("rows", payload)
    if isinstance(payload, dict):
        payload = [payload[k] for k in sorted((k for k in payload if str(k).isdigit()), key=int)]
    return [x for x in payload if isinstance(x, dict)] if isinstance(payload, list) else []


def read_pages(page: object, most: int = MOST_PAGES) -> Iterator[dict]:
    """Rows of page(0), page(1) and so on: until a page isn't there or not full, or has nothing new."""
    seen: set[str] = set()
    for n in range(most):
        payload = page(n)
        found = rows_of(payload) if payload is not None else []
        new = [x for x in found if str(x.get("report_id")) not in seen]
        seen.update(str(x.get("report_id")) for x in new)
        yield from new
        if len(found) < PAGE or not new:
            return


class _Part(InputPartition):
    def __init__(self, day: str, section: str):
        self.day, self.section = day, section


class PagedSource(DataSource):
    """Format `paged`: pages that were fetched lie as JSON in folders day/section/page-N.json.

    Options: path; days and sections, divided by commas (all folders without them). One task reads a day's
    section. A page that can't be read ends its section; the rows before it stand.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "day string, section string, report_id string, title string, report_type string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.days, self.sections = ([x.strip() for x in options.get(k, "").split(",") if x.strip()] for k in ("days", "sections"))

    def partitions(self) -> list[_Part]:
        days = self.days or sorted(os.listdir(self.path))
        return [_Part(d, s) for d in days if os.path.isdir(f"{self.path}/{d}") for s in sorted(os.listdir(f"{self.path}/{d}")) if not self.sections or s in self.sections]

    def read(self, part: _Part) -> Iterator[tuple]:
        def page(n: int) -> object:
            try:
                with open(f"{self.path}/{part.day}/{part.section}/page-{n}.json", encoding="utf-8") as f:
                    return json.load(f)
            except (OSError, ValueError):
                return None

        for x in read_pages(page):
            yield part.day, part.section, *(None if x.get(k) is None else str(x[k]) for k in ("report_id", "title", "report_type"))


def read_paged(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return reduce(lambda r, kv: r.option(*kv), options.items(), spark.read.format("paged").option("path", path)).load()


def sweep_coverage(rows: DataFrame, announced: DataFrame) -> DataFrame:
    """day, collected, announced, ratio: how many of the reports that a day was said to have were found; a ratio is null
    where nothing is known of the day."""
    found = rows.groupBy("day").agg(F.countDistinct("report_id").alias("collected"))
    j = announced.select("day", "announced").join(found, "day", "full_outer")
    n = F.coalesce("collected", F.lit(0).cast("long"))
    return j.select("day", n.alias("collected"), "announced", F.round(F.try_divide(n, F.col("announced")), 6).alias("ratio"))
