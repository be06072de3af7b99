"""Registered queries and their check statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from tallymark.plans import (  # noqa: F401
        bai2_queries,
        function_queries,
        match_queries,
        source_queries,
        stream_queries,
        text_queries,
    )
