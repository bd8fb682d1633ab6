"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

An item is the set of its windows of ten words. A window is contained in a document only if
all its shingles of three words are, so its rarest shingle alone is a sufficient prefix:
documents are joined to the windows on that shingle. What the shingle's position leaves
outside the document is dropped, and the words of the rest are compared with the window's.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from careflow.llm.common import free, small, text_key, written

WINDOW, SHINGLE = 10, 3
# What separates words once A-Z are lower case.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), BETWEEN), "")


def _shingle(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), at + i) for i in range(size)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: window_id, gram (words), items (ids as text, without repeats)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    grams = items.where(F.size("w") > 0).select(
        "item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))).alias("gram")
    )
    # The items of one window are bounded by the benchmark, not by the corpus.
    found = grams.groupBy("gram").agg(F.collect_set("item").alias("items"))
    return written(found.withColumn("window_id", F.monotonically_increasing_id()), "windows")


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window_id, size, off, key) of every shingle of every window; a shorter window is its own shingle."""
    sized = windows.withColumn("size", F.least(F.size("gram"), F.lit(shingle)))
    each = sized.select("window_id", "gram", "size", F.explode(F.sequence(F.lit(0), F.size("gram") - F.col("size"))).alias("off"))
    key = F.lit(None).cast("bigint")
    for size in range(1, shingle + 1):
        key = F.when(F.col("size") == size, _shingle("gram", F.col("off"), size)).otherwise(key)
    return written(each.select("window_id", "size", "off", key.alias("key")), "window-shingles")


def shingle_places(docs: DataFrame, keys: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """Where documents hold a wanted shingle, with the words around, and one row (pos -1) per document."""
    texts = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    texts = texts.withColumn("n_words", F.size("w"))
    parts = []
    for i, size in enumerate(sizes):
        # Position -1 stands for the document itself, once.
        first = -1 if i == 0 else 0
        there = texts if i == 0 else texts.where(F.col("n_words") >= size)
        last = F.greatest(F.col("n_words") - size, F.lit(first))
        each = there.select("*", F.explode(F.sequence(F.lit(first), last)).alias("pos"))
        key = F.when(F.col("pos") >= 0, _shingle("w", F.col("pos"), size)).otherwise(F.xxhash64("doc_id", "text_key"))
        each = each.withColumn("key", key)
        wanted = keys.where(F.col("size") == size).select(F.col("key").alias("wanted"))
        each = each.join(wanted, F.col("key") == F.col("wanted"), "left" if i == 0 else "inner")
        each = each.where((F.col("pos") < 0) | F.col("wanted").isNotNull())
        begin = F.greatest(F.col("pos") - (window - size), F.lit(0))
        around = F.slice("w", begin + 1, 2 * window - size)
        parts.append(each.select(
            "doc_id", "text_key", "n_words", "pos", F.lit(size).alias("size"), "key",
            F.when(F.col("pos") >= 0, begin).alias("begin"), F.when(F.col("pos") >= 0, around).alias("around"),
        ))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return written(found, "shingle-places")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_bytes: int | None = None):
    """(a row per document and text, its occurrences of windows, the windows)."""
    windows = item_windows(benchmark, window)
    shingles = window_shingles(windows, shingle)
    sizes = sorted((r["size"] for r in shingles.select("size").distinct().collect()), reverse=True) or [shingle]
    keys = small(written(shingles.select("size", "key").distinct(), "shingle-keys"), 16, most_bytes)
    places = shingle_places(docs, keys, sizes, window)
    matched = places.where(F.col("pos") >= 0)
    # Rarity over all documents; the rarest shingle of a window is its prefix.
    counts = matched.groupBy("size", "key").agg(F.count(F.lit(1)).alias("times"))
    ordered = shingles.join(counts, ["size", "key"], "left").fillna({"times": 0})
    prefix = ordered.groupBy("window_id").agg(F.min(F.struct("times", "key", "off", "size")).alias("p"))
    prefix = prefix.where(F.col("p.times") > 0).select("window_id", F.col("p.key").alias("key"), F.col("p.off").alias("off"), F.col("p.size").alias("size"))
    prefix = prefix.join(windows.select("window_id", "gram"), "window_id")
    prefix = small(written(prefix, "window-prefixes"), 400, most_bytes)
    start, length = F.col("pos") - F.col("off"), F.size("gram")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice("around", start - F.col("begin") + 1, length) == F.col("gram")
    found = matched.join(prefix, ["size", "key"]).where(inside).where(same)
    found = found.select("doc_id", "text_key", start.alias("start"), (start + length).alias("stop"), "window_id").distinct()
    documents = places.where(F.col("pos") < 0).select("doc_id", "text_key", "n_words")
    return documents, written(found, "window-occurrences"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_bytes: int | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts and items have no words, hits or windows. A null item_id counts as
    the empty id. Repeated rows give repeated results. An empty benchmark hits nothing; no
    documents give no rows. Columns other than doc_id, item_id and text are not read.
    `most_bytes` bounds what is broadcast; beyond it the joins shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents, found, windows = occurrences(docs, benchmark, window, shingle, most_bytes)
    one = ["doc_id", "text_key"]
    before = Window.partitionBy(*one).orderBy("start", "stop", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.col("start")))
    hits = found.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(*one).agg(F.sum("fresh").alias("n_hit"))
    pairs = found.select(*one, "window_id").distinct().join(windows.select("window_id", "items"), "window_id")
    items = pairs.select(*one, F.explode("items").alias("item")).groupBy(*one).agg(F.sort_array(F.collect_set("item")).alias("items"))
    marked = hits.join(items, _same_text(hits, items), "left").select(hits["doc_id"], hits["text_key"], "n_hit", "items")
    marked = small(written(marked, "contaminated"), 200, most_bytes).toDF("__id", "__key", "n_hit", "items")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    return documents.join(marked, same, "left").select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text holds no window of the benchmark."""
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, found, _ = occurrences(wanted, benchmark)
    own, key = free(docs, "__id", "__key")
    bad = written(found.select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct(), "contaminated-ids")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (text_key(F.col("text")) == F.col(key))
    return docs.join(small(bad, 24), same, "left_anti")
