"""Registry of the library's queries with their SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, so that the order of a floating sum does not show."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, 6)
    if name is None and isinstance(column, str):
        name = column
    return out.alias(name) if name else out


def big(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    if name is None and isinstance(column, str):
        name = column
    return c.cast("long").alias(name) if name else c.cast("long")
