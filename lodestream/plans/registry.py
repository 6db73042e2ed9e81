"""Where queries register: a name, a function of (spark, folder) and, if SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
