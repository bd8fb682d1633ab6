"""Signed movements applied in order to a stock that may not fall below zero.

A rejected movement changes what later ones see, so a key is inherently
sequential. Rows are sorted by (key, order) and walked with one running number
per key. A key that holds too many rows for one task is spread over several
sorted blocks; each block is walked from an assumed opening stock, and walked
again only if the block before it turns out to close at another value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from careflow.operators.ordered import BLOCK, HOT_ROWS, PLACE_BITS, hot_keys, place_rows, split_hot
from careflow.session import stored

PLACE = "__place"


def apply_movements(
    moves: DataFrame,
    key: str,
    order: list[str],
    amount: str,
    opening: str,
    hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Adds `applied` and `balance` (NULL when not applied) to every movement.

    `opening` is the stock of the key before its first movement, on every row;
    `amount` and `opening` are whole numbers, `order` is unique within a key, and
    the key is not NULL. `hot` gives the hot keys if they are known.
    """
    if hot is None:
        hot = hot_keys(moves, [key], hot_rows)
    if hot.isEmpty():
        return _walk_keys(moves, key, order, amount, opening)

    large, rest = split_hot(moves, [key], hot)
    walked = _walk_in_blocks(large, key, order, amount, opening, blocks)
    return _walk_keys(rest, key, order, amount, opening).unionByName(walked)


def _walk_keys(moves: DataFrame, key: str, order: list[str], amount: str, opening: str) -> DataFrame:
    placed = moves.repartition(key).sortWithinPartitions(key, *order)
    return placed.mapInArrow(_walker([key], amount, opening), schema=_walked_schema(moves))


def _walked_schema(df: DataFrame) -> str:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return f"{ddl}, applied boolean, balance bigint"


def _walker(keys: list[str], amount: str, opening: str):
    """Walks sorted rows, beginning each new key with its opening stock."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Walk(keys, amount, opening)
        for batch in batches:
            applied, balance = state.advance(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(applied), pa.array(balance, pa.int64(), mask=~applied)],
                names=[*batch.schema.names, "applied", "balance"],
            )

    return walk


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


class _Walk:
    """Stock of the key being walked, kept from one batch of rows to the next."""

    def __init__(self, keys: list[str], amount: str, opening: str):
        self.keys, self.amount, self.opening = keys, amount, opening
        self.current: tuple | None = None
        self.stock = 0

    def advance(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = batch.num_rows
        applied, balance = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
        if not n:
            return applied, balance
        keys = [_values(batch, k) for k in self.keys]
        amounts, openings = _values(batch, self.amount), _values(batch, self.opening)
        differs = np.zeros(n - 1, dtype=bool)
        for column in keys:
            differs |= column[1:] != column[:-1]
        change = np.flatnonzero(differs) + 1
        for lo, hi in zip([0, *change], [*change, n]):
            key = tuple(column[lo] for column in keys)
            if key != self.current:
                self.current, self.stock = key, int(openings[lo])
            self._run(amounts[lo:hi], applied[lo:hi], balance[lo:hi])
        return applied, balance

    def _run(self, amounts: np.ndarray, applied: np.ndarray, balance: np.ndarray) -> None:
        sums = self.stock + np.cumsum(amounts)
        # `balance` and `applied` are views, filled in place.
        if sums.min() >= 0:
            balance[:] = sums
            self.stock = int(sums[-1])
            return
        stock = self.stock
        for i, change in enumerate(amounts.tolist()):
            if stock + change < 0:
                applied[i] = False
            else:
                stock += change
            balance[i] = stock
        self.stock = stock


def _walk_in_blocks(
    moves: DataFrame, key: str, order: list[str], amount: str, opening: str, blocks: int | None
) -> DataFrame:
    """Walks range partitions of (key, order), each part of a key from a stock assumed for it.

    `frontier` has one row per part: the stock it was walked from and the one it leaves. A part is
    walked again when the part before it leaves another stock than that. Every round settles at
    least one more part of each key; on mixed movements two or three rounds settle all.
    """
    columns = moves.columns
    placed = place_rows(moves, [key, *order], PLACE, blocks)
    placed = placed.withColumn(BLOCK, F.shiftright(PLACE, PLACE_BITS).cast("int")).drop(PLACE)
    parts = placed.groupBy(key, BLOCK).agg(
        F.sum(F.col(amount).cast("bigint")).alias("__total"), F.max(opening).cast("bigint").alias("__first")
    )
    # Without rejections a part would begin at the running sum; a sum below zero is taken as an empty
    # stock. Windows over the parts of a key: at most one row per block.
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    freely = F.col("__first") + F.coalesce(F.sum("__total").over(before), F.lit(0))
    parts = parts.withColumn("__free", freely)
    least = F.least(F.lit(0), F.coalesce(F.min("__free").over(Window.partitionBy(key).orderBy(BLOCK)), F.lit(0)))
    todo = stored(parts.select(key, BLOCK, (F.col("__free") - least).alias("__start")), "ledger-frontier")

    previous, frontier, pieces = Window.partitionBy(key).orderBy(BLOCK), None, []
    schema = _walked_schema(moves.select(*columns).withColumns({BLOCK: F.lit(0), "__start": F.lit(0).cast("bigint")}))
    while True:
        # One row per part, so its size is bounded by the number of blocks.
        again = placed.join(F.broadcast(todo), [key, BLOCK]).select(*columns, BLOCK, "__start")
        again = again.repartition(BLOCK, key).sortWithinPartitions(BLOCK, key, *order)
        walked = stored(again.mapInArrow(_walker([BLOCK, key], amount, "__start"), schema=schema), "ledger-walked")
        pieces = [(piece.join(F.broadcast(todo.select(key, BLOCK)), [key, BLOCK], "left_anti")) for piece in pieces]
        pieces.append(walked)
        left = walked.groupBy(key, BLOCK).agg(
            (F.max("__start") + F.sum(F.when(F.col("applied"), F.col(amount).cast("bigint")).otherwise(0))).alias("__left"),
            F.max("__start").alias("__start"),
        )
        if frontier is not None:
            left = left.unionByName(frontier.join(F.broadcast(todo.select(key, BLOCK)), [key, BLOCK], "left_anti"))
        frontier = stored(left, "ledger-frontier")
        came = frontier.withColumn("__came", F.lag("__left").over(previous)).where("__came <> __start")
        todo = stored(came.select(key, BLOCK, F.col("__came").alias("__start")), "ledger-todo")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, [p.select(*columns, "applied", "balance") for p in pieces])
