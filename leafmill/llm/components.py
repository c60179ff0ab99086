"""Connected components by alternating large-star and small-star steps, with each step's edges on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _smallest(edges: DataFrame, parts: int) -> DataFrame:
    """The least neighbour of each u, itself included. Checkpointed: then a join with it has plain exchanges, which AQE can split."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts).checkpoint()


def parts_for(rows: int, each: int = 20_000) -> int:
    """Tasks for so many small rows; at least 8. A few thousand rows need no task for each shuffle partition."""
    return max(8, -(-rows // each))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links (a, b) to (node, label): every node of a link with the smallest node that it reaches.

    Each round costs two aggregations that pre-aggregate and two joins; stars of any size are split by AQE. The rounds end
    once every node has at most one edge down and none of its own at the other end: then all edges are stars.
    Self links give a node its own label. An empty table gives an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    parts = parts_for(2 * edges.count())
    edges = edges.coalesce(parts)
    nodes = edges.filter("u = v").select("u")
    edges = edges.filter("u != v")
    while True:
        both = edges.union(edges.select("v", "u"))
        large = both.join(_smallest(both, parts), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts).checkpoint()
        small = large.join(_smallest(large, parts), "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct().coalesce(parts).checkpoint()
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty():
            break
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).union(nodes.select(F.col("u").alias("node"), F.col("u").alias("label")))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(own).groupBy("node").agg(F.min("label").alias("label")).coalesce(parts).checkpoint()
