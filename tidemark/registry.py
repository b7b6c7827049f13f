"""Query registry: a name, a DataFrame function and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if oracle is not None:
            self.oracle[name] = oracle

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.add(name, f, oracle)
            return f

        return put
