"""Whitening of embeddings with a covariance in which copies weigh what they should.

Equal vectors are one class. The covariance is a centred, weighted matrix product over the classes,
with their number of rows or one as weight; each class is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from careflow.llm.common import remove, written
from careflow.llm.vectors import SLICE_NUMBERS, classes, dense, pieces, summed

SCALE = 256
# Entries become whole numbers below this.
MOST = 2.0**62
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
# An eigenvalue below this share of the trace, per dimension, is zero to double precision.
ZERO = 1e-14


def _keys(numbers: np.ndarray) -> list[bytes]:
    """Bytes that are equal for equal rows only: the narrowest width of a row and its numbers."""
    top = np.maximum(numbers.max(1), -(numbers.min(1) + 1)) if numbers.shape[1] else np.zeros(len(numbers), np.int64)
    width = np.searchsorted([np.iinfo(t).max for t in WIDTHS], top)
    out = [b""] * len(numbers)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for i, row in zip(at.tolist(), numbers[at].astype(WIDTHS[w])):
            out[i] = bytes([w]) + row.tobytes()
    return out


def _numbers(keys: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(keys), size), np.int64)
    kinds = np.array([k[0] for k in keys])
    for w in np.unique(kinds):
        at = np.flatnonzero(kinds == w)
        out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at.tolist()), WIDTHS[w]).reshape(len(at), size)
    return out


def _coded(rows: DataFrame) -> DataFrame:
    """(vec_id, size, key) of the rows whose vector can be used."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "embedding"):
            for at, values in dense(part.column("embedding")):
                with np.errstate(over="ignore"):
                    scaled = np.floor(values * SCALE)
                fits = (np.abs(scaled) < MOST).all(1)
                at, numbers = at[fits], scaled[fits].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)),
                        pa.array(np.full(len(at), numbers.shape[1]), pa.int32()),
                        pa.array(_keys(numbers), pa.binary()),
                    ],
                    names=["vec_id", "size", "key"],
                )

    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.mapInArrow(code, "vec_id bigint, size int, key binary")


def _parts(batches: Iterator[pa.RecordBatch], size: int, counted: bool):
    """(keys, numbers, weights) of pieces of the classes."""
    most = max(1, SLICE_NUMBERS // max(size, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            weights = part.column("rows").to_numpy() if counted else np.ones(part.num_rows, np.int64)
            yield part.column("key"), _numbers(part.column("key").to_pylist(), size), weights


def _totals(fit: DataFrame, size: int, counted: bool) -> tuple[int, list[int]]:
    """The sum of the weights and, per dimension, of the weighted numbers: both exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, numbers, weights in _parts(batches, size, counted):
            most = max(int(np.abs(numbers).max()), 1) * int(weights.max()) * len(weights)
            kind = np.int64 if most < 2**62 else object
            sums = (numbers.astype(kind) * weights.astype(kind)[:, None]).sum(0).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size + 1), pa.int32()), pa.array([str(v) for v in [*sums, int(weights.sum())]])],
                names=["dim", "part"],
            )

    parts = fit.mapInArrow(add, "dim int, part string")
    sums = parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = {r["dim"]: int(r["total"]) for r in sums}
    return total[size], [total[d] for d in range(size)]


def _apart(numbers: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S: exact, as 64-bit numbers where they fit and as Python's otherwise."""
    most = max(int(np.abs(numbers).max()) * n if numbers.size else 0, max(map(abs, total), default=0))
    kind = np.int64 if 2 * most < 2**62 else object
    return numbers.astype(kind) * n - np.array(total, kind)


def _centred(apart: np.ndarray, n: int) -> np.ndarray:
    return apart.astype(np.float64) / n


def _deviation(apart: np.ndarray) -> list[int | None]:
    most = max(abs(int(apart.max())), abs(int(apart.min()))) if apart.size else 0
    if most * most * max(1, apart.shape[1]) < 2**63:
        return (apart.astype(np.int64) ** 2).sum(1).tolist()
    return [v if v < 2**63 else None for v in (sum(x * x for x in row) for row in apart.astype(object))]


def _covariance(fit: DataFrame, size: int, counted: bool, n: int, total: list[int]) -> np.ndarray:
    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, numbers, weights in _parts(batches, size, counted):
            y = _centred(_apart(numbers, n, total), n)
            part = (y * weights[:, None]).T @ y
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size), pa.int32()), pa.array([r.tobytes() for r in sums], pa.binary())],
                names=["row", "part"],
            )

    return np.array(summed(fit.mapInArrow(product, "row int, part binary"))).reshape(size, size) / n


def whiten(table: DataFrame, components: int = 4, weights: str = "one") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row of
    `table` (vec_id, embedding).

    An entry c counts as x = floor(256 c). `weights`: "one" fits on each distinct vector once,
    "count" on every row. n is the sum of the weights, S of the weighted vectors; `deviation` is the
    sum of (n x - S)^2, null where it exceeds 64 bits; `whitened` the centred vector's projection on
    a unit eigenvector of the covariance over the root of its eigenvalue; `explained` that
    eigenvalue's share; `identity_error` how far the whitened vectors' own covariance is from 1.

    Left out are rows whose vector is null, holds a null or non-finite entry, or an entry whose x
    exceeds 2^62, and rows whose vector has another length than most (ties: the longer one).
    Components whose eigenvalue is zero to double precision are not returned, so a table of equal
    vectors gives no row. Repeated rows and null ids are answered row by row; other columns are
    ignored. To the driver come sums and the covariance, whose size depends on the dimensions alone.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    spark, counted = table.sparkSession, weights == "count"
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], out)
    coded = written(_coded(table), "vector-codes")
    common = coded.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None or not common["size"]:
        return empty
    size = common["size"]
    coded = coded.where(F.col("size") == size).select("vec_id", "key")
    fit = written(classes(coded), "vector-classes")
    n, total = _totals(fit, size, counted)
    cov = _covariance(fit, size, counted, n, total)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(cov))
    order = [i for i in order if values[i] > ZERO * size * trace]
    if not order:
        return empty
    # Numbered by falling eigenvalue; the sign is free, here that of the largest entry.
    base = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    base = base / np.sqrt(values[order])
    names = [f"w{k}" for k in range(1, len(order) + 1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, numbers, weight in _parts(batches, size, counted):
            apart = _apart(numbers, n, total)
            white = _centred(apart, n) @ base
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(weight, pa.int64()), pa.array(_deviation(apart), pa.int64()), *map(pa.array, white.T)],
                names=["key", "weight", "deviation", *names],
            )

    ddl = "key binary, weight bigint, deviation bigint, " + ", ".join(f"{c} double" for c in names)
    white = written(fit.mapInArrow(project, ddl), "vector-whitened")
    remove(fit)
    means = white.agg(*[(F.sum(F.col("weight") * F.col(c)) / F.lit(float(n))).alias(c) for c in names]).first()
    apart = {c: F.col(c) - F.lit(means[c]) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    products = white.agg(
        *[(F.sum(F.col("weight") * apart[a] * apart[b]) / F.lit(float(n))).alias(f"{a}_{b}") for a, b in pairs]
    ).first()
    error = max(abs(products[f"{a}_{b}"] - (a == b)) for a, b in pairs)

    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k + 1).cast("int").alias("component"),
                    F.col(c).alias("whitened"),
                    F.lit(float(values[i] / trace)).alias("explained"),
                )
                for k, (c, i) in enumerate(zip(names, order))
            ]
        )
    )
    # A key of most rows is split by adaptive execution: both sides come straight from files.
    joined = coded.join(white.select("key", "deviation", *names), "key").select("vec_id", "deviation", each.alias("c"))
    return joined.select(
        "vec_id", "c.component", F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(float(error)).alias("identity_error"),
    )
