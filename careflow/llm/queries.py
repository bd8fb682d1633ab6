"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from careflow.llm import sql
from careflow.llm.additive import quality
from careflow.llm.chat import format_chats
from careflow.llm.common import read
from careflow.llm.contamination import contamination
from careflow.llm.divergence import divergence_rules
from careflow.llm.idfiles import coded_ids
from careflow.llm.jaccard import near_duplicates
from careflow.llm.packing import pack
from careflow.llm.repeats import removed_repeats
from careflow.llm.runs import repeated_tail, run_digests, word_runs
from careflow.llm.surrogates import surrogates
from careflow.llm.tiles import near_vectors
from careflow.llm.toxicity import toxicity
from careflow.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_distribution_divergence", sql.DIVERGENCE)
def distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence_rules(read(spark, folder, "documents"))


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_additive_quality")
def additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op5_toxicity_ratios")
def toxicity_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op10_chat_roles")
def chat_roles(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(read(spark, folder, "conversations"))


@query("op2_prefix_decontamination", sql.CONTAMINATION)
def prefix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op4_jaccard_join", sql.JACCARD)
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


@query("op7_suffix_repeats")
def suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return removed_repeats(read(spark, folder, "documents"))


@query("op3_surrogates")
def keyed_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates(read(spark, folder, "documents"))


@query("op6_context_mixing_ids")
def context_mixing_ids(spark: SparkSession, folder: str) -> DataFrame:
    return coded_ids(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(word_runs(read(spark, folder, "documents"), repeated_tail))


@query("op12_weighted_whitening")
def weighted_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(read(spark, folder, "embeddings"))


@query("op13_quantised_tiles", sql.VECTORS)
def quantised_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read(spark, folder, "embeddings"))
