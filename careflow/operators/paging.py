"""Ordered listings, pages and lookups."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The row with the key, or none."""
    return df.where(F.col(key) == F.lit(value))


def ordering(spec: list[str]) -> list[Column]:
    """'-name' sorts descending. NULLs come first ascending and last descending."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in spec]


def ordered_listing(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*ordering(order))


def paginate(df: DataFrame, order: list[str], page: int = 1, limit: int = 15) -> DataFrame:
    """One page of the ordered rows; `order` must end in a unique column."""
    return ordered_listing(df, order).offset((page - 1) * limit).limit(limit)


def page_after(df: DataFrame, order: list[str], last: dict[str, Any], limit: int = 15) -> DataFrame:
    """The page after a known row, found by a filter instead of skipping rows.

    The ordering columns must not be NULL.
    """
    later, tied = [], F.lit(True)
    for spec in order:
        name = spec.lstrip("-")
        value = F.lit(last[name])
        step = F.col(name) < value if spec.startswith("-") else F.col(name) > value
        later.append(tied & step)
        tied = tied & (F.col(name) == value)
    return ordered_listing(df.where(reduce(lambda a, b: a | b, later)), order).limit(limit)


def page_info(df: DataFrame, limit: int = 15) -> DataFrame:
    """Row total and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / limit).cast("bigint")
    )


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values that are not blank."""
    return df.select(col).where(F.col(col).isNotNull() & (F.col(col) != "")).distinct().orderBy(col)
