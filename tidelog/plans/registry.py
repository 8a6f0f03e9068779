"""Name -> (query, DuckDB text). ``sql=None`` marks a query that SQL on whole tables cannot check."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep
