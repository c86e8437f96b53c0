"""Connected components by alternating stars, as joins on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.llm.storage import stored

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller and equal) neighbours of every node on its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    times = edges.groupBy("u").agg(F.count("*").alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(1).alias("n")).distinct())
    return times.groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node that it reaches.

    edges has long columns a and b; loops, repeats and either direction are allowed. Rounds grow
    with the logarithm of a component's width. Neighbours are never gathered: a node's least one
    comes from a pre-aggregated minimum.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(ROUNDS):
        if _is_stars(now):
            break
        now = stored(_star(_star(now, large=True), large=False), "stars")
    else:
        raise RuntimeError(f"components not found in {ROUNDS} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.join(now.select(F.col("u").alias("node")), "node", "left_anti"))
