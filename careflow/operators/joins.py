"""Joins of many rows to a table with unique keys, safe when one key holds most rows.

Adaptive execution splits skewed partitions only where both sides of a sort-merge
join come straight from a shuffle. Tables made by an aggregate over the join key
do not, so their joins are split here: small tables are broadcast after their
bytes have been measured, else the few hot keys are joined apart from the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from careflow.operators.ordered import HOT_ROWS, hot_keys, split_hot

# Bytes of a table that may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def _width(value: Column, kind: T.DataType) -> Column:
    """About the bytes a value takes in a broadcast table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_width(value[f.name], f.dataType) for f in kind], F.lit(16))
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(0), lambda total, x: total + _width(x, kind.elementType).cast("int"))
        return F.coalesce(each, F.lit(0)) + 16
    return F.lit(64 if isinstance(kind, T.MapType) else 8)


def is_small(df: DataFrame, most_bytes: int | None = None) -> bool:
    """Whether the rows take at most so many bytes. They are added up where they are: one
    sum per task is moved."""
    most_bytes = BROADCAST_BYTES if most_bytes is None else most_bytes
    width = reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema], F.lit(16))
    return (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes


def join_unique(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    broadcast_bytes: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Joins rows to a table in which every key occurs once.

    `how` is inner, left, left_semi or left_anti; the rows' columns come first, in
    their order. The table is measured first, so it should be cheap to read.
    """
    columns = [*rows.columns, *([c for c in table.columns if c not in keys] if how in ("inner", "left") else [])]
    if is_small(table, broadcast_bytes):
        return rows.join(F.broadcast(table), keys, how).select(*columns)
    if rows.isStreaming:
        return rows.join(table, keys, how).select(*columns)

    # NULL keys match nothing; they need no partner and would all meet in one task.
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    keyed = rows.where(~no_key)
    hot = hot_keys(keyed, keys, hot_rows)
    if hot.isEmpty():
        joined = keyed.join(table, keys, how).select(*columns)
    else:
        large, rest = split_hot(keyed, keys, hot)
        hot_table = F.broadcast(split_hot(table, keys, hot)[0])
        joined = large.join(hot_table, keys, how).select(*columns)
        joined = joined.unionByName(rest.join(table, keys, how).select(*columns))
    if how in ("left", "left_anti"):
        joined = joined.unionByName(rows.where(no_key), allowMissingColumns=True)
    return joined


def join_many(one: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of unique keys to their rows, of which one key may have most.

    Adaptive execution cannot split the optional side of an outer join. The rows
    are joined inner, which it can split or broadcast; keys without rows are added.
    """
    found = many.select(*keys).distinct()
    lonely = one.join(found, keys, "left_anti")
    return many.join(one, keys).unionByName(lonely, allowMissingColumns=True)


def key_summary(
    state: DataFrame, wanted: DataFrame, keys: list[str], *aggs: Column, broadcast_bytes: int | None = None
) -> DataFrame:
    """The state's rows with a wanted key, aggregated per key; without aggregates the keys.

    Wanted keys may repeat. Few filter the state before its shuffle. Many are met
    after it, when the state is down to one row per key.
    """

    def per_key(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()

    if is_small(wanted.select(*keys), broadcast_bytes):
        return per_key(state.join(F.broadcast(wanted.select(*keys)), keys, "left_semi"))
    return per_key(state).join(wanted.select(*keys).distinct(), keys, "left_semi")
