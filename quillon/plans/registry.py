"""Registration of queries: a name, a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, fn: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered already")
        self.queries[name] = fn
        if sql is not None:
            self.oracles[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(fn: Query) -> Query:
            self.add(name, fn, sql)
            return fn

        return put
