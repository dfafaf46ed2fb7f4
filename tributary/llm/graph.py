"""Connected components by alternating large-star and small-star steps, all as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): root is the smallest node that can be reached; nodes without edges are not listed.

    Each step points a node's neighbours at its smallest neighbour. Stars come about after a number of rounds that is
    logarithmic in the nodes; each round is written to the shared folder. A hub's edges are never gathered in one task.
    Self-loops and repeated edges are harmless.
    """
    e = common.saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
        far = common.join_hot(both, low, ["a"], "degree", 2 * mark[0])
        e = far.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        near = common.join_hot(e, low, ["a"], "degree", 2 * mark[0])  # as many edges as both ways at most
        e = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = common.saved(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        old, mark = mark, _mark(e)
        if old == mark:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
