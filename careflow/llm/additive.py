"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees over one feature's bins are boosted in
turn, feature after feature, and add up to one table per feature; then trees over the most
useful pairs add up to one small table per pair. A score is the sum of table entries, found
by vectorised lookups.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, functions as F, types as T

from careflow.llm.common import remainder, slices
from careflow.llm.divergence import COMMON_WORDS, SYMBOLS, duplicate_lines, repeated_words
from careflow.llm.labelled import MAX_ROWS, training_texts

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 150, 60, 0.15, 5.0
THRESHOLD = 0.3

FEATURES = (
    "log_words", "log_chars", "word_length", "symbols", "upper", "digits", "exclamations", "pipes", "other_marks",
    "duplicate_lines", "repeated_words", "same_as_previous", "distinct_words", "common_words", "capitalised",
    "wordless", "log_line_length", "longest_word",
)
LISTED = frozenset(w for words in COMMON_WORDS.values() for w in words)
LETTER = re.compile(r"[^\W\d_]")
UPPER, LOWER = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")
DIGIT, MARK = re.compile("[0-9]"), re.compile(r"[^\w\s.,]")


def features(text: str | None) -> list[float]:
    """Measures of one whole text; null counts as empty, and an empty text measures 0 everywhere."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    upper, lower = len(UPPER.findall(text)), len(LOWER.findall(text))
    symbols = sum(map(text.count, SYMBOLS))
    plain = [w.strip(".,;:!?").lower() for w in words]
    lines = text.count("\n") + 1
    return [
        np.log1p(n), np.log1p(chars), sum(map(len, words)) / n, symbols / chars, upper / max(1, upper + lower),
        len(DIGIT.findall(text)) / chars, text.count("!") / chars, text.count("|") / chars, len(MARK.findall(text)) / chars,
        duplicate_lines(text) / lines, repeated_words(words) / n, sum(map(str.__eq__, words, words[1:])) / n,
        len(set(words)) / n, sum(w in LISTED for w in plain) / n, sum(w[:1].isupper() for w in words) / n,
        sum(not LETTER.search(w) for w in words) / n, np.log1p(chars / lines), np.log1p(max(map(len, words))),
    ]


def measured(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Additive:
    """Edges and a table per feature; a table per pair over coarse bins; the starting log-odds."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            odds += table[np.searchsorted(edges, x[:, j], "right")]
        places = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for j in set().union(*self.pairs)}
        for (a, b), table in self.pairs.items():
            odds += table[places[a], places[b]]
        return 1 / (1 + np.exp(-odds))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree with up to three leaves: the best cut, then the best cut of either side."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo > 1:
                cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (lo, hi), lo + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes: its gain and the value per cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return [a, b, d, c[-1, -1] - a - b - d]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = corners(cg), corners(ch)
    gain = sum(map(_gain, gs, hs)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for (rows, cols), a, b in zip(
        ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
         (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs,
    ):
        out[rows, cols] = -a[i, j] / (b[i, j] + SMOOTH)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """Without rows the score is 0.5; with one label only it stays near that label's share."""
    d = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))), [], [], [], {})
    model.edges = [_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(d)]
    model.coarse = [_edges(x[:, j], PAIR_BINS) if len(x) else np.zeros(0) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(x) or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    odds = np.full(len(x), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size))
            model.tables[j] += step
            odds += step[at[j]]

    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[a] * sizes[b] + rough[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    useful = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(d), 2)))[:pairs]
    model.pairs = {(a, b): np.zeros((sizes[a], sizes[b])) for _, a, b in useful}
    for _ in range(pair_rounds):
        for (a, b), table in model.pairs.items():
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            odds += step[rough[a], rough[b]]
    return model


def measure_texts(batches):
    """Arrow batches of (text, label) to (label, features)."""
    for batch in slices(batches, "text"):
        x = measured(batch.column("text").to_pylist())
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x.tolist(), kind)], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int = MAX_ROWS) -> Additive:
    """Fitted on at most `max_rows` labelled texts; only their features reach the driver."""
    texts = training_texts(docs, labels, label, usable, max_rows).select("text", "label")
    found = texts.mapInArrow(measure_texts, "label int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(found.num_rows, len(FEATURES))
    y = found.column("label").to_numpy().astype(np.float64)
    # The rows arrive in any order; sorted, equal inputs give equal models.
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def scores(docs: DataFrame, model: Additive, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with all its columns and the score of each text."""
    if name in docs.columns:
        raise ValueError(f"there is already a column {name}")

    def run(batches):
        for batch in slices(batches, text):
            found = model.score(measured(batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted.

    Only the text is scored. Null and empty texts get the score of a text that measures 0.
    Rows are held out of training where crc32 of the id is divisible by 5. Repeated rows get
    equal scores; no rows give no rows; other columns are not read.
    """
    model = train(docs, labels, "quality", remainder("doc_id", 5) != 0, max_rows)
    wanted = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return scores(wanted, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
