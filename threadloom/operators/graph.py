"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the least one that the node knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def connected(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root (the least node of its component) for every node of edges(a, b) but the roots themselves.

    keep() writes what a round gives, so lineage doesn't grow; a step is two joins and a min, so a hub is
    pre-aggregated and its join can be split. Rounds end when the links no longer change.
    """
    edges = keep(edges.where("a != b").select("a", "b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = keep(_small(_large(edges).where("a != b").distinct()).where("a != b").distinct())
