"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.session import checkpoint_dir


class Scratch:
    """Written tables of one call. ``put`` writes a table and reads it back, so that a lost executor
    costs one step; ``drop`` deletes tables that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.names = 0

    def put(self, df: DataFrame, *, by: list[str] | None = None) -> DataFrame:
        self.names += 1
        path = f"{self.root}/{self.names}"
        writer = df.write.option("compression", "zstd")
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each that may be sent to every executor (some tens of MB).
MODEST = 1 << 20


def modest(table: DataFrame, limit: int = MODEST) -> DataFrame:
    """``table`` (written, of narrow rows) marked for broadcast if it has at most ``limit`` rows.

    Beyond that it is left as it is, and the join shuffles both sides; the result is the same.
    """
    return F.broadcast(table) if table.count() <= limit else table


def short_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Whole texts reach Python in Arrow batches of ``rows`` at most; the default of 10,000 is kept by no executor
    of small memory. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))


def steady_splits(spark: SparkSession) -> None:
    """Keep the splits of stored tables the same between two reads, so that row numbers by partition agree.

    Spark sizes splits by the cores it has at the time, and executors come and go; the number is fixed at
    its present value for the session unless it is set already.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
