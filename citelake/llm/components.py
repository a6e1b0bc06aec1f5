"""Connected components by alternating large and small stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``(u, v)`` with ``u > v``; only minima and joins, no neighbour lists."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.union(turned) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = around.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): every node of ``edges`` that is not the smallest of its component, with that smallest.

    Each round is written, so a lost executor costs one round; rounds grow with the logarithm of the
    longest path. Loops and repeated edges do no harm; without edges the result is empty.
    """
    now = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        mid = scratch.put(_star(now, True))
        scratch.drop(now)
        now = scratch.put(_star(mid, False))
        scratch.drop(mid)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
        if (row.n, row.s) == mark:
            return now
        mark = (row.n, row.s)
