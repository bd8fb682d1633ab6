"""Labelled training texts for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from careflow.llm.common import written

# Documented bound of the texts a classifier is fitted on: those whose hash of id and text is lowest.
MAX_ROWS = 20_000


def training_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label): at most `max_rows` labelled texts for which `usable` holds, each once.

    Labels other than 0 and 1 and rows without an id are left out. Rows equal in id, text and label
    count once, however often the documents or the labels hold them. Of the ids, those of lowest
    hash take part, and of their texts those whose hash of id and text is lowest. What is sent to
    all executors is bounded by `max_rows`, and so is the result.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(usable).distinct()
    chosen = written(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows), "training-ids")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("place", F.xxhash64("doc_id", "text"))
    # Only ids and hashes are counted; combined before the shuffle, so copies under one id stay few.
    ids = chosen.select("doc_id").distinct()
    places = texts.select("doc_id", "place").join(F.broadcast(ids), "doc_id").distinct()
    places = places.join(F.broadcast(chosen), "doc_id")
    kept = written(places.orderBy("place", "doc_id", "label").limit(max_rows), "training-places")
    # The label is joined last, so a text under two labels is combined once.
    wanted = texts.join(F.broadcast(kept.select("doc_id", "place").distinct()), ["doc_id", "place"]).distinct()
    return wanted.join(F.broadcast(kept), ["doc_id", "place"]).select("doc_id", "text", "label")
