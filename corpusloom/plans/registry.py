"""The query registry: a query by its name, and the DuckDB SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    def put(f: Builder) -> Builder:
        if f.__name__ in QUERIES:
            raise ValueError(f"a query {f.__name__} exists")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put
