"""A stored table with one row per key, updated in place bucket by bucket."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.session import cut_lineage, drop_cut

BUCKETS = 64


class KeyedTable:
    """Rows of ``schema`` under ``path``, the latest of each key (or the first), in ``buckets`` partitions by the key's hash.

    ``latest`` names the columns whose greatest value (compared from left to right) makes a row the latest; all
    other columns break ties, so a merge does not depend on the order of its rows and can be repeated. A merge
    reads and rewrites the buckets of its updates alone. Nulls are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], latest: list[str], buckets: int = BUCKETS, first: bool = False):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.pick = F.min if first else F.max
        self.empty = spark.createDataFrame([], schema)
        rest = [c for c in self.empty.columns if c not in keys]
        self.order = [*latest, *[c for c in rest if c not in latest]]

    def _stored(self) -> DataFrame:
        dealt = self.empty.withColumn("bucket", F.lit(0))
        try:
            return self.spark.read.schema(dealt.schema).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return dealt

    def read(self) -> DataFrame:
        return self._stored().select(self.empty.columns)

    def of(self, rows: DataFrame) -> DataFrame:
        """The stored rows in the buckets that ``rows`` have, with their bucket; other buckets are not read."""
        touched = self._dealt(rows).select("bucket").distinct()
        return self._stored().join(F.broadcast(touched), "bucket", "left_semi")  # as many rows as buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def merge(self, updates: DataFrame) -> None:
        """Keep the latest row of each key. The result is written beside the table first, then its partitions
        take the place of the old ones; a failed merge can be run again."""
        names = self.empty.columns
        new = self._dealt(updates.select(names))
        rows = self.of(updates).select(*names, "bucket").unionByName(new)
        best = rows.groupBy("bucket", *self.keys).agg(self.pick(F.struct(*self.order)).alias("__last"))
        staged = cut_lineage(best.select(*self.keys, "__last.*", "bucket").select(*names, "bucket"))
        writer = staged.repartition(self.buckets, "bucket").write.partitionBy("bucket").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)
        drop_cut(staged)
