"""Connected components by alternating stars: every edge ends at the least node of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (above it, or below it and itself) to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of ``edges`` (``u``, ``v``) that is not its own root.

    Each round is checkpointed; rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, before = checkpointed(pairs.distinct()), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        edges = checkpointed(_star(_star(edges, True), False))
