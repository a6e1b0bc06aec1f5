"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes of Parquet that a scan task reads at most, and of shuffled rows that adaptive execution merges for one task.
SPLIT = 16 << 20


def short_splits(spark: SparkSession) -> None:
    """Let a task read ``SPLIT`` bytes. Groups that are formed, and first rows that are sorted, are held by the task on
    both sides of a shuffle, so its memory follows its split and not the size of the table. Smaller settings of the
    session stay; a row group is never cut, and a shuffle has no more parts than the session gives it."""
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > SPLIT:
            spark.conf.set(key, str(SPLIT))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    short_splits(spark)
    return spark.read.parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A table whose rows need much work each, with enough partitions for the cores.

    A row group is read by one task, so a table in fewer files than there are cores would leave
    cores idle during pattern matching; only then are its rows dealt out. A large table has more
    files than cores, and its rows are not shuffled.
    """
    table = read_table(spark, path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table
