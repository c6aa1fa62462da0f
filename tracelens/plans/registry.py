"""The queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) under its name."""

    def add(make):
        QUERIES[make.__name__] = make
        if sql:
            SQL[make.__name__] = sql
        return make

    return add
