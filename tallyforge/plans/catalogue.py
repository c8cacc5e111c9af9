"""Register of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its twin where SQL can express it."""

    def put(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.strip()
        return f

    return put
