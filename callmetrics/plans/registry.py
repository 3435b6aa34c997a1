"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callmetrics.sources.binding import OPERATIONS_SQL, TURNS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

OPS = "with " + OPERATIONS_SQL + " "
FACTS = "with " + OPERATIONS_SQL + ", " + TURNS_SQL + " "
FAILED_SQL = "(status = 'error' and coalesce(error_name not in ('AbortError', 'CancelledError', 'CancelledException'), true))"
INTERRUPTED_SQL = "(status = 'cancelled' or (status = 'error' and coalesce(error_name in ('AbortError', 'CancelledError', 'CancelledException'), false)))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
