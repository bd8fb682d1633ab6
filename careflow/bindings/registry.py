"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from careflow.bindings.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the views; `sql` is the same result in DuckDB."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Views(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return register


# Parameters used by the registered queries.
MONTH = "1997-03"
START, END = "1997-01-01", "1997-06-30"
AS_OF = "1998-06-15"
DAY = "1997-03-05"
EVENT_MONTH = "2024-01"
EVENT_START, EVENT_END = "2024-01-10", "2024-01-20"
