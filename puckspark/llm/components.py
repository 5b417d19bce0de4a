"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckspark.session import pin


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (a, b); the component is its smallest node.

    Each round joins every node with the smallest neighbour, first among all and then among the
    smaller ones; the number of rounds grows with the logarithm of the longest path. A node with very
    many neighbours is only counted (map-side) and joined, where skewed keys are split. Self loops
    give a component of one node; an empty table gives none.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        now = pin(small)
    return nodes.join(now, nodes.node == now.a, "left").select("node", F.coalesce("b", "node").alias("component"))
