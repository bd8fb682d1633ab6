"""From raw documents to packed training sequences: five stages, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from careflow.llm.additive import THRESHOLD, scores, train
from careflow.llm.common import free, read, remainder, remove_path
from careflow.llm.contamination import without_contaminated
from careflow.llm.jaccard import one_of_each
from careflow.llm.packing import pack
from careflow.llm.surrogates import replace_personal
from careflow.session import shared_path, ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Trained on the labelled ones."""
    ship(spark)
    model = train(docs, read(spark, sf_dir, "labels"), "quality", remainder("doc_id", 5) != 0)
    (name,) = free(docs, "__quality")
    return scores(docs, model, name=name).where(F.col(name) >= THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def replace_entities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; n_chars follows the text."""
    ship(spark)
    replaced = replace_personal(docs)
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII surrogates", replace_entities),
    ("best-fit packing", pack_sequences),
]

# No SQL expresses the classifier, the surrogates or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
