"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("low").alias("node"), F.col("high").alias("near")).unionByName(
        edges.select(F.col("high").alias("node"), F.col("low").alias("near"))
    )
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("least"))
    return (
        both.where(F.col("near") > F.col("node")).join(least, "node")
        .select(F.col("least").alias("low"), F.col("near").alias("high")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high")
    return (
        moved.select(F.col("least").alias("low"), F.col("low").alias("high"))
        .unionByName(least.select(F.col("least").alias("low"), "high"))
        .where(F.col("low") != F.col("high")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    ``edges`` holds (low, high) with low < high; repeated edges are fine. Each round is written to
    the shared folder. Both steps reduce by node before they join, so a node with very many
    neighbours is a skewed join side that Spark splits, and no list of neighbours exists. The number
    of edges does not grow.
    """
    current = written(edges.select("low", "high").distinct(), "edges")
    while True:
        following = written(_small_star(_large_star(current)), "edges")
        # Finished once every edge is a star's: then the step gives the same edges again.
        if (
            following.join(current, ["low", "high"], "left_anti").isEmpty()
            and current.join(following, ["low", "high"], "left_anti").isEmpty()
        ):
            return following.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
                following.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        current = following
