"""Name -> (Spark query, SQL) registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftframe.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under a name."""

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(prepare(spark), folder)

        run.__name__ = name
        run.__doc__ = function.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register
