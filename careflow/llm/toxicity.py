"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of 3 to 5 characters of the lower-cased text
whose white space is blanks. Its scale is the log ratio of the shares of toxic and other
training texts that hold it; the most telling n-grams are kept and a logistic regression is
fitted on the scaled presences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from careflow.llm.common import mixed, remainder, slices, written
from careflow.llm.labelled import MAX_ROWS, training_texts

SIZES, BITS, KEPT = (3, 4, 5), 20, 4096
SMOOTH, PENALTY, STEPS = 1.0, 0.5, 300
THRESHOLD = 0.7
STEP = np.uint64(0x9E3779B97F4A7C15)


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the texts, with repeats. Null counts as empty."""
    padded = [" " + " ".join((t or "").lower().replace("\0", " ").split()) + " \0" for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    inside = codes != 0
    h, ok = codes.copy(), inside.copy()
    rows, buckets = [], []
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * STEP + codes[n - 1 :]
        ok = ok[:-1] & inside[n - 1 :]
        if n in SIZES:
            found = mixed(h + np.uint64(n)) >> np.uint64(64 - BITS)
            rows.append(row[: len(h)][ok])
            buckets.append(found[ok].astype(np.int32))
    return np.concatenate(rows), np.concatenate(buckets)


def present(texts: list, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs; only buckets for which `keep` holds, if given."""
    row, bucket = ngrams(texts)
    if keep is not None:
        at = np.flatnonzero(keep[bucket])
        row, bucket = row[at], bucket[at]
    pairs = np.unique(row.astype(np.int64) << BITS | bucket)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def count_ngrams(batches):
    """Arrow batches of (text, label): per bucket the toxic and other texts that hold it."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in slices(batches, "text"):
        label = batch.column("label").to_numpy()
        row, bucket = present(batch.column("text").to_pylist())
        for value in (0, 1):
            counts[value] += np.bincount(bucket[label[row] == value], minlength=1 << BITS)
    at = np.flatnonzero(counts.any(axis=0))
    for some in np.array_split(at, max(1, len(at) // 50_000)):
        columns = [pa.array(some.astype(np.int32)), pa.array(counts[1][some]), pa.array(counts[0][some])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "toxic", "other"])


@dataclass
class Ratios:
    """A weight per bucket (0 where it has none) and the starting log-odds."""

    weights: np.ndarray
    start: float

    def score(self, texts: list) -> np.ndarray:
        row, bucket = present(texts, self.weights != 0)
        odds = self.start + np.bincount(row, self.weights[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_logistic(row: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty, by accelerated gradient steps over all rows."""
    n, d = len(y), len(scale)
    value = scale[feature]
    share = (y.sum() + 1) / (n + 2)
    w, start = np.zeros(d), float(np.log(share / (1 - share)))
    # The curvature is at most a quarter of the largest squared row norm, plus the intercept's.
    norm = np.bincount(row, value * value, n)
    # Power steps bound the largest eigenvalue of the scaled presences more tightly.
    v = np.ones(d) / np.sqrt(max(d, 1))
    top = norm.max(initial=1.0)
    for _ in range(20):
        u = np.bincount(row, value * v[feature], n)
        v = np.bincount(feature, value * u[row], d)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1 / (0.25 * (1.2 * top + n) + PENALTY)
    now, b = (w, start), 1.0
    ahead = now
    for _ in range(STEPS):
        odds = ahead[1] + np.bincount(row, value * ahead[0][feature], n)
        off = 1 / (1 + np.exp(-odds)) - y
        slope = np.bincount(feature, value * off[row], d) + PENALTY * ahead[0]
        new = (ahead[0] - rate * slope, ahead[1] - rate * float(off.sum()))
        c = (1 + np.sqrt(1 + 4 * b * b)) / 2
        ahead = tuple(p + (b - 1) / c * (p - q) for p, q in zip(new, now))
        now, b = new, c
    return now


def kept_features(places: np.ndarray):
    """Arrow batches of (text, label) to (label, the kept features present)."""

    def run(batches):
        for batch in slices(batches, "text"):
            row, bucket = present(batch.column("text").to_pylist(), places >= 0)
            parts = np.split(places[bucket], np.cumsum(np.bincount(row, minlength=batch.num_rows))[:-1])
            found = pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), found], names=["label", "found"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, usable, max_rows: int = MAX_ROWS, kept: int = KEPT) -> Ratios:
    """Fitted on at most `max_rows` labelled texts. The driver gets at most `kept` n-grams
    and, per training text, which of them it holds."""
    texts = written(training_texts(docs, labels, label, usable, max_rows).select("text", "label"), "toxic-texts")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    share = (toxic + 1) / (toxic + other + 2)
    weights = np.zeros(1 << BITS)
    if not toxic or not other:
        return Ratios(weights, float(np.log(share / (1 - share))))
    counts = texts.mapInArrow(count_ngrams, "bucket int, toxic bigint, other bigint")
    counts = counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    p, q = (F.col("toxic") + SMOOTH) / (toxic + 2 * SMOOTH), (F.col("other") + SMOOTH) / (other + 2 * SMOOTH)
    # How far the two shares lie apart against their spread.
    spread = F.sqrt(p * (1 - p) / toxic + q * (1 - q) / other)
    telling = counts.select("bucket", F.log(p / q).alias("ratio"), F.abs((p - q) / spread).alias("weight"))
    best = telling.orderBy(F.desc("weight"), "bucket").limit(kept).toArrow()
    buckets, scale = best.column("bucket").to_numpy(), best.column("ratio").to_numpy()
    places = np.full(1 << BITS, -1, np.int32)
    places[buckets] = np.arange(len(buckets))
    rows = texts.mapInArrow(kept_features(places), "label int, found array<int>").toArrow()
    found = rows.column("found").combine_chunks()
    row = np.repeat(np.arange(rows.num_rows), np.diff(found.offsets.to_numpy()))
    y = rows.column("label").to_numpy().astype(np.float64)
    w, start = fit_logistic(row, found.flatten().to_numpy(), scale, y)
    weights[buckets] = w * scale
    return Ratios(weights, float(start))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted.

    Only the text is scored; null counts as empty, and an empty text gets the starting odds.
    Rows are held out of training where crc32 of the id leaves 1 modulo 3. Repeated rows get
    equal scores; no rows give no rows; other columns are not read.
    """
    model = train(docs, labels, "toxic", remainder("doc_id", 3) != 1, max_rows)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    start = model.start

    def run(batches):
        ratios = Ratios(weights.value, start)
        for batch in slices(batches, "text"):
            found = ratios.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    wanted = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return wanted.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
