"""What operators on blocks of rows share: vectors as bytes, equal ones as one class, block sums, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Numbers of vectors that a task works on at once.
SLICE_NUMBERS = 1 << 19


def dense(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) per vector length of an Arrow list column: the vectors that
    are not null and hold no null or non-finite entry."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    begins = column.offsets.to_numpy()[:-1].astype(np.int64)
    values = column.values.cast(pa.float64())
    numbers = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        matrix = numbers[begins[rows][:, None] + np.arange(length)]
        good = np.isfinite(matrix).all(1)
        if good.any():
            yield rows[good], matrix[good]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about SLICE_NUMBERS numbers (one row at least)."""
    for batch in batches:
        ends, at = batch.column(column).offsets.to_numpy(), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_NUMBERS, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def matrix(keys: pa.Array, dtype: str) -> np.ndarray:
    """Rows of a binary column whose values hold equally many numbers of one type."""
    data = np.concatenate([np.frombuffer(k, dtype) for k in keys.to_pylist()]) if len(keys) else np.zeros(0, dtype)
    return data.reshape(len(keys), -1)


def summed(parts: DataFrame) -> list[np.ndarray]:
    """Adds up rows (row int, part binary of doubles), which each task has at most once per row, and
    returns the sums by row. Their number and width must be bounded by the number of dimensions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, part in zip(batch.column("row").to_pylist(), batch.column("part").to_pylist()):
                values = np.frombuffer(part, np.float64)
                total[row] = total[row] + values if row in total else values
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                names=["row", "part"],
            )

    once = parts.repartition("row").mapInArrow(add, "row int, part binary")
    return [np.frombuffer(part, np.float64) for _, part in sorted((r["row"], bytes(r["part"])) for r in once.collect())]


def classes(coded: DataFrame, *aggs) -> DataFrame:
    """One row per distinct `key` with `rows`, its number; counted before the shuffle."""
    return coded.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *aggs)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]):
    """The values of `columns` per run of equal keys of a sorted partition."""
    now, held = None, None
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
            if key != now:
                if held is not None:
                    yield now, *held
                now, held = key, tuple([] for _ in columns)
            for into, column in zip(held, values):
                into.append(column[i])
    if held is not None:
        yield now, *held


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; `label` holds each one's least member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label[:] = label[label]
