"""Registry of queries: name -> Spark plan, and the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under its function's name, with its SQL where SQL can express it."""

    def register(fn: Query) -> Query:
        if fn.__name__ in PLANS:
            raise ValueError(f"two queries are called {fn.__name__}")
        PLANS[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register
