"""Near duplicates among embeddings by tiled products of 8-bit vectors.

Equal vectors are one class. Classes are dealt into groups by a hash of their bytes; each pair of
groups is one piece of work. A unit vector u is kept as whole numbers q with u = q / s + rest, and
the length of the rest is computed, so that

    |u.v - q_u.q_v / (s_u s_v)| <= rest_u + rest_v + rest_u rest_v.

The products of whole numbers are exact. Pairs that this bound does not place below the threshold
are computed again in double precision from the vectors themselves, which only their rows fetch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from careflow.llm.common import remove, small, written
from careflow.llm.components import components
from careflow.llm.vectors import classes, dense, grouped, matrix, merge, pieces

THRESHOLD = 0.95
# Vectors of a group, and numbers it may hold (long vectors make smaller groups).
GROUP, GROUP_NUMBERS = 8192, 1 << 22
# Rows of a tile; a multiple of eight, for one bit per pair.
TILE = 1024
# Products of 8-bit numbers add up exactly in single precision over so many dimensions.
EXACT = (1 << 24) // (127 * 127)
# Far above the rounding of the doubles that go into a bound, far below any rest.
SLACK = 1e-9
# Pairs computed again at once.
PAIRS = 1 << 16

TILES = "size int, grp int, tile int, cid binary, q binary, scale binary, rest binary"
WANTED = "pair string, side int, place int, cid bigint, bits binary"
FOUND = "cid bigint, links bigint, root bigint"


def _coded(rows: DataFrame, dtype: str) -> DataFrame:
    """(row, vec_id, size, key): the vector's bytes; null where it links with nothing."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "embedding"):
            keys: list[bytes | None] = [None] * part.num_rows
            size = np.zeros(part.num_rows, np.int32)
            for at, values in dense(part.column("embedding")):
                values = (values + 0.0).astype(dtype)  # one zero
                for i, vector in zip(at.tolist(), values):
                    if vector.any():
                        keys[i], size[i] = vector.tobytes(), len(vector)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(size), pa.array(keys, pa.binary())], names=["vec_id", "size", "key"]
            )

    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.mapInArrow(code, "vec_id bigint, size int, key binary")


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Double precision, each row times a power of two, so that no square leaves the range."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit numbers, scale, and length of the rest of the unit vectors along the rows."""
    unit = _scaled(vectors)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    scale = 127.0 / np.abs(unit).max(1)
    q = np.rint(unit * scale[:, None])
    rest = unit - q / scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((rest * rest).sum(1))


def _tiles(found: DataFrame, dtype: str) -> DataFrame:
    """The classes of a group in tiles of like scale."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size, grp), cids, keys in grouped(batches, ("size", "grp"), ("cid", "key")):
            q, scale, rest = quantised(matrix(pa.array(keys, pa.binary()), dtype))
            cids, order = np.array(cids, np.int64), np.argsort(scale, kind="stable")
            for tile, at in enumerate(range(0, len(order), TILE)):
                of = order[at : at + TILE]
                yield pa.RecordBatch.from_pylist(
                    [
                        dict(size=size, grp=grp, tile=tile, cid=cids[of].tobytes(), q=q[of].tobytes(),
                             scale=scale[of].tobytes(), rest=rest[of].tobytes())
                    ],
                    schema=pa.schema(
                        [("size", pa.int32()), ("grp", pa.int32()), ("tile", pa.int32())]
                        + [(c, pa.binary()) for c in ("cid", "q", "scale", "rest")]
                    ),
                )

    dealt = found.select("size", "grp", "cid", "key").repartition("size", "grp").sortWithinPartitions("size", "grp")
    return dealt.mapInArrow(build, TILES)


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Whether the bound leaves room for the threshold, for all pairs of two tiles (q, scale, rest)."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    product = np.zeros((len(qa), len(qb)), np.float32)
    for at in range(0, qa.shape[1], EXACT):
        part = qa[:, at : at + EXACT].astype(np.float32) @ qb[:, at : at + EXACT].astype(np.float32).T
        product = part if qa.shape[1] <= EXACT else product.astype(np.float64) + part
    # First one limit per row, below the limits of all its pairs; then each remaining pair's own.
    limit = sa * ((sb * (threshold - SLACK - rb)).min() - (sb * (1 + rb)).max() * ra)
    out = product >= np.nextafter(limit.astype(np.float32), np.float32(-np.inf))[:, None]
    i, j = np.nonzero(out)
    room = ra[i] + rb[j] + ra[i] * rb[j] + SLACK
    out[i, j] = product[i, j] / (sa[i] * sb[j]) + room >= threshold
    return out


def _candidates(tiles: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """The rows of each pair of groups that may have a partner, the first side's with a bit per row of the second."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("grp", "cid", "q", "scale", "rest")
        for (size, a, b), grp, cid, q, scale, rest in grouped(batches, ("size", "a", "b"), columns):
            sides = []
            for g in (a, b):
                at = [i for i, x in enumerate(grp) if x == g]
                part = [
                    (np.frombuffer(q[i], np.int8).reshape(-1, size), np.frombuffer(scale[i]), np.frombuffer(rest[i])) for i in at
                ]
                ids = [np.frombuffer(cid[i], np.int64) for i in at]
                sides.append((part, np.concatenate(ids) if ids else np.zeros(0, np.int64)))
            (left, left_ids), (right, right_ids) = sides
            bits = np.zeros((len(left_ids), -(-len(right_ids) // 8)), np.uint8)
            row = 0
            for i, x in enumerate(left):
                column = 0
                for j, y in enumerate(right):
                    if a != b or i <= j:
                        hit = possible(x, y, threshold)
                        if a == b and i == j:
                            hit = np.triu(hit, 1)
                        packed = np.packbits(hit, axis=1)
                        bits[row : row + len(x[0]), column // 8 : column // 8 + packed.shape[1]] = packed
                    column += len(y[0])
                row += len(x[0])
            one, two = np.flatnonzero(bits.any(1)), np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, 0)) if len(bits) else [])
            # Bits of the rows that count only, so that a pair of groups with few candidates stays small.
            for at in range(0, len(one), TILE):
                rows = one[at : at + TILE]
                yield _rows(f"{size} {a} {b}", 0, at, left_ids[rows], np.packbits(np.unpackbits(bits[rows], axis=1)[:, two], axis=1))
            if len(one):
                yield _rows(f"{size} {a} {b}", 1, 0, right_ids[two], None)

    def _rows(pair: str, side: int, at: int, cids: np.ndarray, bits: np.ndarray | None) -> pa.RecordBatch:
        n = len(cids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([pair] * n, pa.string()),
                pa.array(np.full(n, side), pa.int32()),
                pa.array(np.arange(at, at + n), pa.int32()),
                pa.array(cids),
                pa.array([None] * n if bits is None else [x.tobytes() for x in bits], pa.binary()),
            ],
            names=["pair", "side", "place", "cid", "bits"],
        )

    others = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    sent = tiles.join(small(counts, 16), "size").withColumn("other", others)
    keys = [F.least("grp", "other").alias("a"), F.greatest("grp", "other").alias("b")]
    sent = sent.select("size", *keys, "grp", "tile", "cid", "q", "scale", "rest")
    return sent.repartition("size", "a", "b").sortWithinPartitions("size", "a", "b", "grp", "tile").mapInArrow(meet, WANTED)


def _verified(wanted: DataFrame, found: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """(cid, links, root) per class and pair of groups: linked vectors there, and the least class linked to it there."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, cid, bits, key, rows in grouped(batches, ("pair",), ("side", "cid", "bits", "key", "rows")):
            n = side.index(1)
            vectors = _scaled(matrix(pa.array(key, pa.binary()), dtype))
            length = np.sqrt((vectors * vectors).sum(1))
            cid, weight = np.array(cid, np.int64), np.array(rows, np.int64)
            ids, of = np.unique(cid, return_inverse=True)
            links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            step = max(1, PAIRS // (len(side) - n))
            for at in range(0, n, step):
                mask = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in bits[at : min(at + step, n)]]), axis=1)
                i, j = np.nonzero(mask[:, : len(side) - n])
                i, j = i + at, j + n
                near = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (length[i] * length[j]) >= threshold
                i, j = i[near], j[near]
                np.add.at(links, of[i], weight[j])
                np.add.at(links, of[j], weight[i])
                merge(label, of[i], of[j])
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(links[at]), pa.array(ids[label[at]])], names=["cid", "links", "root"]
            )

    fetched = wanted.join(found.select("cid", "key", "rows"), "cid")
    return fetched.repartition("pair").sortWithinPartitions("pair", "side", "place").mapInArrow(check, FOUND)


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `table` (vec_id, embedding).

    Two rows are linked when the cosine of their vectors, in double precision, reaches `threshold`
    (above 0, at most 1); equal vectors always are. `n_links` counts the other rows linked directly,
    `component_id` is the least vec_id that can be reached, `kept` whether it is the row's own.

    Vectors that are null, empty, zero, or hold a null or non-finite entry, and vectors of different
    length, are linked with nothing. Repeated rows are rows of their own, linked to each other. Ids
    that are null count as larger than any; a component of such rows alone has none and keeps all.
    Other columns are ignored. An empty table gives an empty one.

    Every pair of classes is compared in some task: the arithmetic grows with the square of the
    number of different vectors, and each class is sent to every group in 8-bit form. What comes out
    of a pair of groups has at most one row per class of it, never one per pair.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    kind = table.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    coded = written(_coded(table, dtype), "vector-codes")
    found = classes(coded, F.min("vec_id").alias("first"), F.first("size").alias("size"))
    found = written(found.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    per_group = F.greatest(F.lit(1), F.least(F.lit(GROUP), F.floor(F.lit(GROUP_NUMBERS) / F.col("size"))))
    counts = found.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.select("size", F.ceil(F.col("n") / per_group).cast("int").alias("groups")), "vector-groups")
    dealt = found.join(small(counts, 16), "size").withColumn("grp", F.pmod(F.xxhash64("key"), "groups").cast("int"))
    tiles = written(_tiles(dealt, dtype), "vector-tiles")
    wanted = written(_candidates(tiles, counts, threshold), "vector-candidates")
    remove(tiles)
    pairs = written(_verified(wanted, found, dtype, threshold), "vector-links")
    remove(wanted)

    named = components(pairs.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = written(named.select(F.col("node").alias("cid"), F.col("component")), "vector-components")
    links = pairs.groupBy("cid").agg(F.sum("links").alias("links"))
    about = found.select("cid", "key", "rows", "first").join(links, "cid", "left").join(named, "cid", "left")
    about = written(about.withColumn("component", F.coalesce("component", "cid")), "vector-named")
    least = about.groupBy("component").agg(F.min("first").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0).cast("bigint")) + F.col("rows") - 1
    answer = written(about.join(least, "component").select("key", n_links.alias("n_links"), "component_id"), "vector-answers")

    # Rows of one frequent vector are split by adaptive execution: both sides come straight from files.
    linked = coded.where(F.col("key").isNotNull()).select("vec_id", "key").join(answer, "key")
    alone = coded.where(F.col("key").isNull())
    alone = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
