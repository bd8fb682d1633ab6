"""Ordered computations that stay balanced when one key holds a large share of the rows.

A window over a key sorts that whole key in one task. Keys are counted first, and
the few with too many rows are computed apart: they are cut into range partitions
("blocks") of the full order, computed block by block, and joined up through one
small row per block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from careflow.session import materialise, stored

# Rows of one group that one task may sort alone.
HOT_ROWS = 1_000_000

BLOCK = "__block"
# Bits that Spark gives the place of a row within its partition.
PLACE_BITS = 33


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more rows than that: at most rows / hot_rows of them.

    Counts are combined before the shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return materialise(counts.where(F.col("__n") > hot_rows).select(*keys))


def split_hot(df: DataFrame, keys: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the hot keys and the others. NULL counts as a key."""
    few = F.broadcast(hot.toDF(*[f"__hot_{k}" for k in keys]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys])
    return df.join(few, same, "left_semi"), df.join(few, same, "left_anti")


def order_value(order: list[str]) -> Column:
    """The order as one comparable value; a single column stays plain, which hash
    aggregates can hold."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def ordered_blocks(
    df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None
) -> DataFrame:
    """Rows range-partitioned and sorted by (keys, order), with their block number.

    Written out once: block numbers must not change between two readings.
    """
    by = [*keys, *order]
    cut = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    return materialise(cut.withColumn(BLOCK, F.spark_partition_id()).sortWithinPartitions(*by))


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    amount: Column | str,
    name: str,
    hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Adds the sum of `amount` over the rows of the key up to and with this row.

    `order` must be unique within a key. `hot` gives the hot keys if they are known.
    """
    df = df.withColumn("__amount", F.col(amount) if isinstance(amount, str) else amount)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_key = F.sum("__amount").over(upto.partitionBy(*keys))
    if hot is None:
        hot = hot_keys(df, keys, hot_rows)
    if hot.isEmpty():
        return df.withColumn(name, by_key).drop("__amount")

    large, rest = split_hot(df, keys, hot)
    summed = _running_sum_in_blocks(large, keys, order, name, blocks)
    return rest.withColumn(name, by_key).unionByName(summed).drop("__amount")


def _running_sum_in_blocks(
    df: DataFrame, keys: list[str], order: list[str], name: str, blocks: int | None
) -> DataFrame:
    staged = ordered_blocks(df, keys, order, blocks)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a block can have come from an earlier block, so
    # `carry` has at most one row per block.
    carry = (
        staged.groupBy(BLOCK, *keys)
        .agg(F.sum("__amount").alias("__total"))
        .withColumn("__carry", F.sum("__total").over(before))
        .where(F.col("__carry").isNotNull())
        .select(F.col(BLOCK), F.struct(*keys).alias("__key"), "__carry")
    )
    upto = Window.partitionBy(BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_key = F.struct(*keys).eqNullSafe(F.col("__key"))
    return (
        staged.withColumn(name, F.sum("__amount").over(upto))
        .join(F.broadcast(carry), BLOCK, "left")
        .withColumn(name, F.col(name) + F.when(same_key, F.col("__carry")).otherwise(F.lit(0)))
        .drop(BLOCK, "__key", "__carry")
    )


def rank_in_group(
    df: DataFrame, keys: list[str], order: list[str], name: str, hot_rows: int = HOT_ROWS,
    blocks: int | None = None, hot: DataFrame | None = None,
) -> DataFrame:
    """Adds 1, 2, 3 … within the key."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name, hot_rows, blocks, hot)


def place_rows(df: DataFrame, order: list[str], name: str, blocks: int | None = None) -> DataFrame:
    """The rows in order, written once, each with a number that grows with the order but has gaps:
    the range partition, and the place in it."""
    cut = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    return stored(cut.sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "placed-rows")


def number_rows(
    df: DataFrame, order: list[str], name: str, start: int = 0, blocks: int | None = None
) -> DataFrame:
    """Adds start + 1, start + 2, … over all rows in the order."""
    placed = place_rows(df, order, "__place", blocks)
    # The upper bits of a place are its partition, the lower ones count from 0 in it.
    part, local = F.shiftright("__place", PLACE_BITS), F.col("__place").bitwiseAND(F.lit(2**PLACE_BITS - 1))
    # One row per partition, so the unpartitioned window is small.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + local + F.lit(start + 1).cast("bigint"))
        .select(*df.columns, name)
    )


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. `order` must be unique within a key."""
    return _pick(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. `order` must be unique within a key."""
    return _pick(df, keys, order, F.max)


def _pick(df: DataFrame, keys: list[str], order: list[str], choose) -> DataFrame:
    """Keys and order alone are aggregated, in a hash table before the shuffle; the rows follow by a
    semi-join on keys and order, so the rows of a hot key spread over all tasks."""
    best = df.groupBy(*[F.col(k).alias(f"__key_{k}") for k in keys]).agg(choose(order_value(order)).alias("__best"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return df.join(best, same & order_value(order).eqNullSafe(F.col("__best")), "left_semi")
