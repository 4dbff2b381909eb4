"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.plans.workspace import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node either hangs on exactly one other node or has nodes hanging on it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return roles.where("hangs + holds > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of ``edges(u, v)``; ``component`` is the smallest reachable node.

    Loops and edges with a null end are left out. Each round is written to the
    shared folder, which cuts the lineage at a place that outlives executors.
    """
    real = edges.where("u is not null and v is not null and u != v")
    stars = stored(real.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_star_forest(stars):
        stars = stored(_small_star(_large_star(stars)), "edges")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
