"""Connected groups of rows, from edges to the smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.session import cut_lineage, drop_cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches, itself included.

    Each round hooks every root to the smallest root next to it and then halves the paths, so rounds grow with
    the logarithm of the longest path. Only minima and joins are used: no list of neighbours is built. Rounds
    are written and old ones deleted.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    at = cut_lineage(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(at.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
        near = near.join(at.select(F.col("node").alias("a"), F.col("root").alias("own")), "a").where(F.col("other") < F.col("own"))
        hooks = cut_lineage(near.groupBy("own").agg(F.min("other").alias("up")))
        if hooks.isEmpty():
            drop_cut(hooks, both)
            return at
        jumps = hooks
        while True:  # roots point to smaller roots, so paths end
            ahead = jumps.select(F.col("own").alias("up"), F.col("up").alias("top"))
            new = cut_lineage(jumps.join(ahead, "up", "left").select("own", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            drop_cut(jumps)
            jumps, done = new, new.where("moved").isEmpty()
            if done:
                break
        ends = jumps.select(F.col("own").alias("root"), "up")
        new = cut_lineage(at.join(ends, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        drop_cut(jumps, at)
        at = new
