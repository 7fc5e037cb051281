"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least neighbour, or to itself if that is less."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    linked = down.join(least, F.col("u") == F.col("c"))
    return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).union(linked.select("m", "u")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b); isolated nodes aren't listed.

    Minima are aggregated before they are shuffled, so that a node with very many neighbours is no task of its own.
    """
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        edges = store(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before:
            break
        before = now
    star = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return star.union(edges.select("a", "a").distinct())
