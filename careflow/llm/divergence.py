"""Quality rules by distribution divergence.

Each document's character classes and common words are counted. Per language, the
counts of all documents that pass the base rules and are long enough are added up to a
first reference, and those of the ones nearer to it than the mean to the reference that
judges. A document whose histogram lies too far from its language's reference
(Jensen-Shannon distance, 0 to 1) is rejected; short documents are not judged by a
histogram that is mostly noise at their length.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from careflow.llm.common import written

# Frequent function words of the languages that have a word reference.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
}
# What may stand around a word, the symbols, the punctuation, the white space.
AROUND = ".,;:!?\"'()"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()-"
SPACE = " \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "letter", "digit", "space", "punctuation", "symbol", "other")

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
# Guards: documents below these lengths are not judged by that histogram.
MIN_CLASS_CHARS, MIN_COMMON_WORDS = 250, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.185, 0.45
# A reference of fewer characters or words judges nothing.
MIN_REFERENCE = 1000


def _class_of(ch: str) -> int:
    if ch in SPACE:
        return 4
    if ch in SYMBOLS:
        return 6
    if ch in PUNCTUATION:
        return 5
    kind = unicodedata.category(ch)
    if kind == "Ll":
        return 0
    if kind == "Lu":
        return 1
    return 2 if kind[0] == "L" else 3 if kind[0] == "N" else 7


def _class_table() -> np.ndarray:
    """Class of each code point of the basic plane; the last entry stands for all above."""
    return np.array([_class_of(chr(c)) if not 0xD800 <= c < 0xE000 else 7 for c in range(0xFFFF)] + [7], np.uint8)


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words covered by windows of that many words that occur twice or more."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    covered, end = 0, 0
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


COUNTED = (
    "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, classes array<bigint>, common array<bigint>"
)


def count_texts(batches):
    """Arrow batches of (doc_id, text, lang) to the counts of each text."""
    table = _class_table()
    places = {lang: {w: i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
    kind = pa.list_(pa.int64())
    for batch in batches:
        out = []
        for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
            text = text or ""
            lang = lang if lang in places else ""
            words = text.encode().split()
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            classes = np.bincount(table[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))
            common = []
            if lang:
                at = places[lang]
                common = [0] * (len(at) + 1)
                for w, n in Counter(words).items():
                    common[at.get(w.decode().lower().strip(AROUND), -1)] += n
            out.append((
                doc_id, lang, len(words), len(codes) - int(classes[4]), int(classes[6]), duplicate_lines(text),
                repeated_words(words), classes.tolist(), common,
            ))
        names = ("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")
        types = (pa.int64(), pa.string(), *[pa.int64()] * 5, kind, kind)
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Distance of two histograms of equal length; null where either is empty or missing."""

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def information(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def both(a: Column, b: Column) -> Column:
        p, q = a / total(counts), b / total(reference)
        m = (p + q) / 2
        return (information(p, m) + information(q, m)) / 2

    apart = F.aggregate(F.zip_with(counts, reference, both), F.lit(0.0), lambda a, x: a + x)
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(apart, F.lit(0.0))))


def _added(column: str, length: int) -> Column:
    """Element-wise sums of an array column."""
    return F.array(*[F.coalesce(F.sum(F.get(column, i)), F.lit(0)) for i in range(length)])


def _references(counted: DataFrame) -> DataFrame:
    """Added-up histograms: a row per listed language and one for all others, whatever the data."""
    widest = max(map(len, COMMON_WORDS.values())) + 1
    sums = counted.groupBy("lang").agg(
        _added("classes", len(CLASSES)).alias("ref_classes"), _added("common", widest).alias("ref_common")
    )
    return sums.withColumn("ref_common", F.slice("ref_common", 1, _listed(F.col("lang"))))


def _against(counted: DataFrame, reference: DataFrame) -> DataFrame:
    return (
        counted.join(F.broadcast(reference), "lang", "left")
        .withColumn("classes_distance", jensen_shannon(F.col("classes"), F.col("ref_classes")))
        .withColumn("common_distance", jensen_shannon(F.col("common"), F.col("ref_common")))
    )


def divergence_rules(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_class_chars: int = MIN_CLASS_CHARS,
    min_common_words: int = MIN_COMMON_WORDS,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang; other columns are not read).

    Null or empty text has no words and fails the base rules. A language without a word
    list, or null, is judged by character classes only, against the pooled other texts.
    Repeated rows give repeated results and each counts in the reference. An empty table
    gives no rows.
    """
    wanted = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = written(wanted.mapInArrow(count_texts, COUNTED), "divergence-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    class_fit = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x) >= min_class_chars
    word_fit = F.col("n_words") >= min_common_words
    good = counted.where(~F.col("base_failed") & class_fit & word_fit)
    # Texts farther than their language's mean from a first reference are left out of the
    # second, so that junk does not blur what it is measured against.
    near = _against(good, _references(good))
    mean = near.groupBy("lang").agg(F.avg("classes_distance").alias("class_mean"))
    near = near.join(F.broadcast(mean), "lang").where(F.col("classes_distance") <= F.col("class_mean"))
    judged = _against(counted, _references(near))

    def far(counts: str, ref: str, most: float, fit: Column) -> Column:
        enough = F.aggregate(ref, F.lit(0).cast("bigint"), lambda a, x: a + x) >= MIN_REFERENCE
        return F.when(fit & enough, F.col(f"{counts}_distance") > most)

    rejected = F.coalesce(far("classes", "ref_classes", max_class_distance, class_fit), F.lit(False)) | F.coalesce(
        far("common", "ref_common", max_word_distance, word_fit), F.lit(False)
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
        F.round("classes_distance", 6).alias("class_distance"),
        F.round("common_distance", 6).alias("word_distance"),
    )


def _listed(lang: Column) -> Column:
    """Length of a language's word histogram: its words and one place for all others."""
    size = F.lit(0)
    for name, words in COMMON_WORDS.items():
        size = F.when(lang == name, len(words) + 1).otherwise(size)
    return size
