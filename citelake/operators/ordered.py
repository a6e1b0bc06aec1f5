"""Ordered scans within a key that hold when one key has a third of all rows.

A plain window puts all rows of a key into one task. Here the order is cut into blocks of
``width``: each block is summed up by a partial aggregation, the block sums are scanned per key,
and the rows are then scanned per (key, block). A task holds one block, never one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_B, _AT = "__block", "__at"


def _blocked(df: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Rows with the place of their block: key and block as one struct, which is never null and in which nulls are
    equal. The scan of the blocks and the join of their carries are both dealt out by it, so rows are sent once."""
    return df.withColumn(_AT, F.struct(*keys, F.floor(F.col(order) / width).alias(_B)))


def _before(keys: list[str]) -> W:
    return W.partitionBy(*[f"{_AT}.{k}" for k in keys]).orderBy(f"{_AT}.{_B}").rowsBetween(W.unboundedPreceding, -1)


def _with_carry(rows: DataFrame, per_block: DataFrame) -> DataFrame:
    """Join block carries to the scanned rows."""
    return rows.join(per_block.select(_AT, "__carry"), _AT, "left")


def fill_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    width: int,
    inclusive: bool = False,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Last non-null ``value`` among the preceding rows of the key (or up to this row)."""
    rows = _blocked(df.withColumn("__value", value), keys, order, width)
    # one row per block, also for blocks without values: they take the last value before them
    place = F.struct(order, *ties) if ties else F.col(order)
    per_block = rows.groupBy(_AT).agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), place)).alias("__last")
    )
    carries = per_block.withColumn("__carry", F.last("__last", ignorenulls=True).over(_before(keys)))
    frame = W.partitionBy(_AT).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(frame))
    return _with_carry(local, carries).withColumn(out, F.coalesce("__local", "__carry")).drop(_AT, "__carry", "__local", "__value")


def number_rows(
    df: DataFrame, keys: list[str], order: str, out: str, width: int, ties: tuple[str, ...] = ()
) -> DataFrame:
    """1-based row number within the key."""
    rows = _blocked(df, keys, order, width)
    counts = rows.groupBy(_AT).agg(F.count(F.lit(1)).alias("__n"))
    carries = counts.withColumn("__carry", F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)))
    local = rows.withColumn("__local", F.row_number().over(W.partitionBy(_AT).orderBy(order, *ties)))
    return _with_carry(local, carries).withColumn(out, F.col("__carry") + F.col("__local")).drop(_AT, "__carry", "__local")


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including this one."""
    rows = _blocked(df.withColumn("__value", value), keys, order, width)
    sums = rows.groupBy(_AT).agg(F.sum("__value").alias("__n"))
    carries = sums.withColumn("__carry", F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)))
    frame = W.partitionBy(_AT).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.sum("__value").over(frame))
    return _with_carry(local, carries).withColumn(out, F.col("__carry") + F.col("__local")).drop(_AT, "__carry", "__local", "__value")


def trailing_count(df: DataFrame, keys: list[str], order: str, span: int, out: str) -> DataFrame:
    """Rows of the key whose order lies in ``(order - span, order]``.

    Every row goes to its own block of ``span`` and, as a neighbour only, to the next one; a window
    per (key, block) then sees all rows it may need.
    """
    rows = df.withColumn("__own", F.floor(F.col(order) / span))
    both = rows.withColumn(_B, F.explode(F.array("__own", F.col("__own") + 1)))
    frame = W.partitionBy(*keys, _B).orderBy(order).rangeBetween(-(span - 1), 0)
    return (
        both.withColumn(out, F.count(F.lit(1)).over(frame))
        .where(F.col(_B) == F.col("__own"))
        .drop(_B, "__own")
    )
