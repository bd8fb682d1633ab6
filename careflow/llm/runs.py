"""Periodic runs of words: where a text repeats itself back to back, and the text without the repeats.

A run of period q and exponent four holds at least three neighbouring places of the grid 0, q, 2q, ...
whose words equal the next grid place's. These few places are found by comparing the grid with
itself (over all q that is n/1 + n/2 + ... words); the common extensions of each to the right and
to the left then give the run's ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from careflow.llm.common import slices
from careflow.llm.coverlce import CoverLce

# A run is at least this long, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Grid places compared at once for large periods.
CHUNK = 1 << 20
# Periods whose grids are compared one by one; larger ones have few places and are taken together.
SINGLE = 64
# More matches of one small period than this are replaced by one for each of its stretches.
MANY = 64

Rewrite = Callable[[int | None, int], "np.ndarray | None"]


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word each place takes when a tenth of the documents get a repeated tail: with h the
    crc32 of the id in decimal (null: of nothing) and h % 10 = 0, the words from a = (h // 10) % n on
    repeat their first 1 + (n - a) // (3 + (h // 10) % 8). None leaves a document as it is."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def _stretches(codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the longest stretches of period q, at least four periods long."""
    step = np.diff(np.concatenate([[False], codes[q:] == codes[:-q], [False]]).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + q
    long = end - start >= LEAST_PERIODS * q
    return start[long], end[long]


def _grid_matches(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of places, among them one inside each run, that begin three matches with the next place."""
    places, periods = [], []
    # Stretches of small periods that have many matches: where they begin and end.
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fresh(place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """False where a match lies in a stretch whose period divides its own: it gives the same stretch again."""
        out = np.ones(len(place), bool)
        for q, (start, end) in known.items():
            at = np.searchsorted(start, place, "right") - 1
            out &= (period % q != 0) | (at < 0) | (place + 3 * period >= end[at])
        return out

    def keep(streak: np.ndarray, base: np.ndarray, period: np.ndarray) -> None:
        # streak: whether three matches begin here. A run holds such a triple whole; every third begin of
        # an unbroken stretch and its last one meet each triple.
        at = np.flatnonzero(streak)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[((np.arange(len(at)) - begin) % 3 == 0) | np.append(new[1:], True)]
            place = base[at] if base is not None else at * period
            of = period[at] if base is not None else np.full(len(at), period)
            new = fresh(place, of)
            place, of = place[new], of[new]
            if base is None and len(place) > MANY:
                start, end = _stretches(codes, period)
                if len(start):
                    known[period] = start, end
                place, of = start, np.full(len(start), period)
            places.append(place)
            periods.append(of)

    most = min(longest // LEAST_PERIODS, len(codes) // LEAST_PERIODS)
    for q in range(1, min(most, SINGLE) + 1):
        grid = codes[::q]
        same = grid[1:] == grid[:-1]
        if len(same) >= 3:
            keep(same[:-2] & same[1:-1] & same[2:], None, q)
    q = SINGLE + 1
    while q <= most:
        last = min(most, q + max(1, CHUNK * q // len(codes)))
        of = np.arange(q, last + 1)
        counts = (len(codes) - 1) // of + 1
        ends = np.cumsum(counts)
        period = np.repeat(of, counts)
        place = (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * period
        grid = codes[place]
        # The last place of a period's grid is followed by place 0 of the next: never counted as equal.
        same = (grid[1:] == grid[:-1]) & (period[1:] == period[:-1])
        keep(same[:-2] & same[1:-1] & same[2:], place, period)
        q = last + 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _closed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, each text between closing codes that occur once; each position's text; each text's first place."""
    first = np.cumsum(counts + 1) - counts
    out = np.empty(int(counts.sum()) + len(counts) + 1, np.int64)
    is_word = np.zeros(len(out), bool)
    is_word[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))] = True
    out[is_word] = codes
    top = int(codes.max()) + 1 if len(codes) else 0
    out[~is_word] = top + np.arange(len(counts) + 1)
    owner = np.repeat(np.arange(len(counts) + 1), np.append(counts + 1, 1))
    return out, owner, first


def find_runs(codes: np.ndarray, counts: np.ndarray, v: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period. `codes` are the words of
    all texts one after the other, `counts` the words of each."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(codes):
        return none
    whole, owner, first = _closed(codes, counts)
    place, period = _grid_matches(whole, int(counts.max()))
    # A grid meets equal words of several texts too: such places are in no run, and their partners not among the texts sorted.
    inside = owner[place] == owner[place + period]
    place, period = place[inside], period[inside]
    if not len(place):
        return none
    # Only texts with matches are sorted. A word's owner is its text: closing code t comes before text t.
    text = owner[place]
    keep = np.zeros(len(counts), bool)
    keep[text] = True
    some, owner, begin = _closed(codes[np.repeat(keep, counts)], counts[keep])
    number = np.cumsum(keep) - 1
    a = place - first[text] + begin[number[text]]
    b = a + period
    n = len(some)
    right = CoverLce(some, owner, v).lce(a, b)
    back = CoverLce(some[::-1].copy(), owner[::-1].copy(), v)
    left = back.lce(n - a, n - b)  # from the places before a and b; a text's first place follows a closing code
    start, end = a - left, b + right
    length = end - start
    good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    text, start, length, period = text[good], (start - begin[number[text]])[good], length[good], period[good]
    # One stretch found with several periods has them all as multiples of the least.
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
    return flat.filter(pa.array(real)), counts.astype(np.int64)


RUNS = "array<struct<start bigint, length bigint, period bigint>>"


def _slab(ids: list[int | None], texts: pa.Array, rewrite: Rewrite | None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts of some documents."""
    flat, counts = _words(texts)
    ends = np.cumsum(counts)
    index = np.arange(len(flat))
    for i, doc_id in enumerate(ids if rewrite else ()):
        places = rewrite(doc_id, int(counts[i]))
        if places is not None:
            index[ends[i] - counts[i] : ends[i]] = places + ends[i] - counts[i]
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[index]
    text, start, length, period = find_runs(codes, counts)
    # A place is dropped while more runs have begun their repeats than have ended.
    change = np.zeros(len(flat) + 1, np.int64)
    base = ends[text] - counts[text] if len(text) else text
    np.add.at(change, base + start + period, 1)
    np.add.at(change, base + start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    words = flat.take(pa.array(index[kept]))
    lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words)
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    per_text = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))]).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return counts, pa.ListArray.from_arrays(pa.array(per_text), rows), collapsed


def word_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of `docs` (doc_id, text).

    `runs` are the maximal stretches of words that equal the word one smallest period on, of at
    least LEAST_WORDS words and LEAST_PERIODS periods, by start and period. `collapsed` are the words
    joined by single spaces, without those that a run repeats after its first period. `rewrite`
    gives the place whose word each place takes instead of its own, per id and number of words.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and rows
    without an id are each answered on their own; other columns are ignored. An empty table gives an
    empty one. A text is handled in one piece: its table of sampled suffixes stays near
    `coverlce.SAMPLES` rows up to some ten million words, by the choice of the cover.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, runs, collapsed = _slab(part.column("doc_id").to_pylist(), part.column("text"), rewrite)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), runs, collapsed],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: least start, then period) and digests
    of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    start, length, period = -F.col("best.col2"), F.col("best.length"), -F.col("best.col3")
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
