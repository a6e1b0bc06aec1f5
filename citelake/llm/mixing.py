"""Mixing sources to target weights by exact subset sums over text sizes.

Targets: sources in code-point order weigh 5, 2, 1, 5, ...; they share ``SHARE`` of all words, no
target exceeds ``REPEATS`` times its source, and the excess is shared again by weight. A source
takes all its documents ``floor(target / size)`` times; the rest of the target is a subset sum. Documents
are counted by exact size; every size gets its proportional number of documents, and the remaining
budget is filled by a bounded-knapsack program over the counts that are left. Within a size the
documents are drawn by seeded hash, so reruns agree.

The program of a source sees one row per distinct size, never its documents. A size of very many
documents is drawn by hash slots: whole slots, then ranks within the one slot where the number ends.

Defined results: null and blank texts have size 0 and take 0; the null source comes last; sources
without words have target 0; equal rows are drawn independently; rows without an id are drawn by
their text's hash. Other columns are ignored; ``mix`` returns them unchanged, repeats as further rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm.store import Scratch, modest, steady_splits

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = 20
SLOTS = 4096  # hash slots of a size
WINDOW = 1 << 13  # words left to the knapsack program


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    body = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.size(F.split(body, r"[\x20\x09-\x0D]+"))
    return F.when(text.isNull() | (body == ""), F.lit(0)).otherwise(words).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): one row per source; water filling by running sums.

    The windows run over sources, not documents. Sorted by cap over weight, the capped sources are a
    prefix; the first level that caps no further source is the answer.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    weighed = totals.withColumn("w", weight).withColumn("cap", REPEATS * F.col("source_size"))
    ratio = F.col("cap") / F.col("w")
    up = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    budget = F.lit(SHARE) * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    found = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= ratio)
    final = F.min(F.when(F.col("fits"), F.struct(ratio.alias("r"), F.col("level").alias("level")))).over(whole)["level"]
    share = F.least(F.col("cap").cast("double"), final * F.col("w"))
    return found.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def subset_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size to take so that their sizes come as near under ``budget`` as possible.

    ``sizes`` are distinct and positive. Proportional numbers first, less one document of a size where
    that is needed to leave the program ``window`` words; then reachable sums as bits of one integer.
    """
    total = int(sizes @ counts)
    if budget >= total:
        return counts.copy()
    take = counts * budget // max(total, 1)
    left = budget - int(sizes @ take)
    for i in np.argsort(-sizes).tolist():  # a document more of the sizes that still fit
        if left - sizes[i] >= window and take[i] < counts[i]:
            more = min(int(counts[i] - take[i]), 1)
            take[i] += more
            left -= more * int(sizes[i])
    for i in np.argsort(sizes).tolist():
        if left >= window:
            break
        back = min(int(take[i]), -(-(window - left) // int(sizes[i])))
        take[i] -= back
        left += back * int(sizes[i])
    full = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for i in np.argsort(-sizes).tolist():
        if sizes[i] > left:
            continue
        free, pack = int(counts[i] - take[i]), 1
        free = min(free, left // int(sizes[i]))
        while free > 0 and not reach >> left & 1:
            use = min(pack, free)
            steps.append((i, use, reach))
            reach |= reach << use * int(sizes[i]) & full
            free -= use
            pack *= 2
    at = reach.bit_length() - 1
    for i, use, before in reversed(steps):
        if not before >> at & 1:
            take[i] += use
            at -= use * int(sizes[i])
    return take


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """One source: (source, size, n) with target and source_size; adds ``full`` and ``extra``."""
    whole = int(group["source_size"].iloc[0])
    target = float(group["target"].iloc[0])
    full = min(int(target // whole), REPEATS) if whole else 0
    budget = int(round(target - full * whole)) if full < REPEATS else 0
    sizes = group["size"].to_numpy(np.int64)
    extra = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    if budget > 0:
        extra[some] = subset_counts(sizes[some], group["n"].to_numpy(np.int64)[some], budget)
    return group[["source", "size"]].assign(full=full, extra=extra)


def plan(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, full, extra): how often each size is taken whole, and how many more of it."""
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    rows = counts.join(goals, counts["source"].eqNullSafe(goals["source"])).select(counts["source"], "size", "n", "source_size", "target")
    return rows.groupBy("source").applyInPandas(_fit, "source string, size long, full int, extra long")


def draw(sized: DataFrame, plan_: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` (with ``h``, a hash of the row) and ``times``, how often the mix takes the row."""
    marked = sized.withColumn("slot", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(SLOTS)))
    slots = marked.groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    p = plan_.withColumnsRenamed({"source": "ps", "size": "pz"})
    slots = slots.join(p, slots["source"].eqNullSafe(p["ps"]) & (slots["size"] == p["pz"]))
    slots = slots.select(
        F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("slot").alias("pslot"), "full",
        F.least("n", F.greatest(F.col("extra") - F.col("before"), F.lit(0))).alias("room"), "n",
    )
    joined = marked.join(
        slots, marked["source"].eqNullSafe(slots["ps"]) & (marked["size"] == slots["pz"]) & (marked["slot"] == slots["pslot"])
    ).drop("ps", "pz", "pslot")
    split = (F.col("room") > 0) & (F.col("room") < F.col("n"))
    clear = joined.where(~split).withColumn("times", F.col("full") + (F.col("room") > 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy(F.xxhash64("h", F.lit(seed + 1)), "h"))
    edge = joined.where(split).withColumn("rank", rank)
    edge = edge.withColumn("times", F.col("full") + (F.col("rank") <= F.col("room")).cast("int")).drop("rank")
    return clear.unionByName(edge).drop("slot", "room", "n", "full")


def _sized(docs: DataFrame, *columns: Column) -> DataFrame:
    h = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(*columns, F.col("source"), size_of(F.col("text")).alias("size"), h.alias("h"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted), one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.put(_sized(docs, F.col("doc_id")))
    goals = scratch.put(targets(sized))
    drawn = draw(sized, scratch.put(plan(sized, goals)))
    named = goals.withColumnRenamed("source", "gs")
    out = drawn.join(named, drawn["source"].eqNullSafe(named["gs"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` (a stored table) with all columns, each as often as it is taken.

    Rows are drawn without their texts; the numbers then meet the texts by row id.
    """
    scratch = Scratch(docs.sparkSession)
    steady_splits(docs.sparkSession)
    row = F.monotonically_increasing_id()
    sized = scratch.put(_sized(docs, row.alias("id")))
    drawn = draw(sized, scratch.put(plan(sized, scratch.put(targets(sized)))))
    taken = scratch.put(drawn.where("times > 0").select("id", "times"))
    whole = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), row.alias("id"))
    again = whole.join(modest(taken), "id").withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return again.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
