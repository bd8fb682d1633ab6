"""Best-fit packing with Martello-Toth dominance reduction.

The instance is a histogram of piece lengths: at most `capacity` numbers, whatever the
corpus. On it, sets of one or two pieces that provably dominate every alternative are
fixed, the rest is packed best-fit decreasing, and the result is a list of patterns with
the number of sequences each is used for. Every piece then finds its place from its length
and its rank among the pieces of that length, so no piece passes through the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from careflow.llm.common import slices, small, written
from careflow.llm.tokens import encoder

CAPACITY, END_ID = 4096, 1

# A pattern: its runs (length, times) in order, and the number of sequences that look so.
Pattern = tuple[list[tuple[int, int]], int]


def fix_dominating(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Takes out of `counts` the sets that some optimal packing contains.

    From the longest length down, with `rest` the room beside one piece of it:
    nothing fits beside it: it stays alone; the longest piece that fits fills the room, or
    no two others fit together, or no three do and no two that fit are longer together: the
    pair with that piece dominates every set that holds the first.
    """
    fixed: list[Pattern] = []
    for i in range(capacity, 0, -1):
        while counts[i]:
            counts[i] -= 1
            there = np.flatnonzero(counts)
            rest = capacity - i
            fitting = there[there <= rest]
            counts[i] += 1
            if not len(fitting):
                # Beside a second copy of the same length nothing fits either.
                fixed.append(([(i, 1)], int(counts[i])))
                counts[i] = 0
                break
            j = int(fitting[-1])
            if i + j != capacity and not _pairs_dominated(counts, fitting, i, j, rest):
                break
            times = int(counts[i] // 2 if i == j else min(counts[i], counts[j]))
            fixed.append(([(i, 1), (j, 1)] if i != j else [(i, 2)], times))
            counts[i] -= times
            counts[j] -= times
    return fixed


def _pairs_dominated(counts: np.ndarray, fitting: np.ndarray, i: int, j: int, rest: int) -> bool:
    """No two fitting pieces are longer together than j, and no three fit at all."""
    left = counts[fitting] - (fitting == i)
    smallest = np.repeat(fitting[:3], np.minimum(left[:3], 3))[:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > rest:
        return True
    if len(smallest) == 3 and smallest.sum() <= rest:
        return False
    at = np.searchsorted(fitting, rest - fitting, "right") - 1
    ok = (at > np.arange(len(fitting))) | ((at == np.arange(len(fitting))) & (left >= 2))
    # With a single piece of that length its partner is the next shorter one.
    lone = (at == np.arange(len(fitting))) & (left < 2) & (at > 0)
    partner = np.where(lone, at - 1, at)
    sums = np.where((ok | lone) & (at >= 0), fitting + fitting[partner], 0)
    return int(sums.max(initial=0)) <= j


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing, in bulk: alike sequences are filled alike."""
    room: dict[int, list[list]] = {}
    open_rooms = np.zeros(capacity + 1, bool)
    done: list[Pattern] = []

    def put(left: int, runs: list[tuple[int, int]], times: int) -> None:
        if not times:
            return
        if not left:
            done.append((runs, times))
            return
        room.setdefault(left, []).append([runs, times])
        open_rooms[left] = True

    for length in range(capacity, 0, -1):
        have = int(counts[length])
        while have:
            wide = np.flatnonzero(open_rooms[length:])
            if len(wide):
                left = length + int(wide[0])
                runs, times = room[left].pop()
                if not room[left]:
                    open_rooms[left] = False
            else:
                left, runs, times = capacity, [], have
            each = left // length
            full = min(times, have // each)
            put(left - each * length, [*runs, (length, each)], full)
            have -= full * each
            times -= full
            if times and 0 < have < each:
                put(left - have * length, [*runs, (length, have)], 1)
                have, times = 0, times - 1
            if runs:
                put(left, runs, times)
    return done + [(runs, times) for groups in room.values() for runs, times in groups]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return fix_dominating(counts, capacity) + best_fit(counts, capacity)


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, pieces per sequence, first sequence, first offset), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for runs, times in patterns:
        offset = 0
        for length, each in runs:
            first = used.get(length, 0)
            rows.setdefault(length, []).append((first, each, sequence, offset))
            used[length] = first + each * times
            offset += length * each
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def cut_texts(path: str, capacity: int, end_id: int):
    """Arrow batches of (doc_id, text) to pieces, each numbered among its partition's of that length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, part = encoder(path).ids, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            out = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    length = len(cut) // 4
                    out.append((doc_id, piece, at // 4, length, zlib.crc32(cut), part, int(seen[length])))
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=NAMES)

    return run


def assign(where: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                rows = where[int(value)]
                first, each, base, begin = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                sequence[at] = base + (rank[at] - first) // each
                offset[at] = begin + (rank[at] - first) % each * value
            out = [batch.column(n) for n in NAMES[:5]] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, names=[*NAMES[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and `end_id`, cut into pieces and laid into sequences of at most `capacity`.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null or
    empty text is the end id alone. Repeated rows are packed each. No rows give no rows;
    columns other than doc_id and text are not read.
    """
    wanted = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pieces = written(wanted.mapInArrow(cut_texts(tokenizer, capacity, end_id), PIECE), "pack-pieces")
    by_part = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = small(written(offsets, "pack-offsets"), 32)
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    packed = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select(*NAMES[:5], "rank").mapInArrow(assign(places(solve(histogram, capacity))), packed)
