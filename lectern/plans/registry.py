"""The named queries: a function of (spark, folder) and, where one exists, the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, in the order in which they were added."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def add(f: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"query {name} is defined twice")
            self.plans[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
