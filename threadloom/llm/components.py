"""Connected components of a link table, by alternating large-star and small-star steps.

Every node ends up linked to the smallest node of its component. Each step is two joins and a min, so a hub with
many links is pre-aggregated and its join can be split; the links are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root for every node of edges(a, b) but the roots themselves."""
    edges = materialize(edges.where("a != b").select("a", "b").distinct(), label)
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        before = state
        edges = _small_star(_large_star(edges).where("a != b").distinct()).where("a != b").distinct()
        edges = materialize(edges, label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
