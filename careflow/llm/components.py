"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from careflow.llm.common import remove, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _starred(edges: DataFrame, both: bool) -> DataFrame:
    """Every node's neighbours linked to the least of them (large star: all; small star: the smaller ones)."""
    ahead = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = ahead.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = ahead.join(least, "u")
    if both:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b): the least node that can be reached.

    Counts are combined before each shuffle and a hub's edges are split by adaptive
    execution. Rounds grow with the logarithm of a component's size.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(links.where(F.col("a") != F.col("b")).select(u, v).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        large = _starred(edges, both=True).where(F.col("u") != F.col("v")).distinct()
        new = written(_starred(large, both=False).where(F.col("u") != F.col("v")).distinct(), "edges")
        remove(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
