"""Connected components by alternating large and small stars; every step is a join on a node, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelode.llm.stored import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is tied to the least node of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour smaller than a node, and the node, is tied to the least of them. Edges run from greater to smaller."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return tied.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node of it) for the nodes of `links` (a, b) other than that least node itself."""
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    state = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
