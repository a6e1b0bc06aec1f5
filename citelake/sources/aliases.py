"""Acronym files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(alias, meaning, pos)`` of an acronym CSV in file order; the byte-order mark is dropped.

    Only the first two columns are read. ``multiLine`` keeps the (small) file in one split, so that the
    position is the order of lines.
    """
    raw = spark.read.option("header", False).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    first, second = raw.columns[:2]
    rows = raw.select(
        F.replace(F.trim(first), F.lit("﻿"), F.lit("")).alias("alias"),
        F.trim(second).alias("meaning"),
        F.monotonically_increasing_id().alias("pos"),
    )
    header = (F.upper("alias") == "SIGLAS") & (F.upper("meaning") == "SIGNIFICADO")
    return rows.where(~F.coalesce(header, F.lit(False)) & F.col("alias").isNotNull() & F.col("meaning").isNotNull())
