"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.sources.tables import Tables


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Register a function of Tables under a name, with the SQL that gives the same rows."""

        def put(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return plan

        return put
