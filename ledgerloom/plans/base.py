"""How plan modules name their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> tuple[Callable, dict[str, Query], dict[str, str]]:
    """A decorator that enters a function, with its DuckDB SQL if it has some, and the two tables it enters them in."""
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def put(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return put

    return query, queries, sqls
