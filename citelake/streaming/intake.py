"""Document intake: new files to mentions, each document once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.operators.extract import extract
from citelake.session import checkpoint_dir, cut_lineage
from citelake.sources.keyed import BUCKETS, KeyedTable


def arriving(spark: SparkSession, path: str, schema, pattern: str) -> DataFrame:
    """Stream of the Parquet files that match ``pattern``, without documents that arrive again.

    Equal documents (same id and text) are taken once, however far apart they arrive. There is no
    watermark: a file's time says nothing about its documents, and restored or copied files have old
    ones. The state keeps one (id, digest) per document and grows with their number.
    """
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    # without it the source passes over files that are a week older than the newest one
    files = source.option("maxFileAge", "36500d").parquet(path)
    return files.withColumn("digest", F.md5("text")).dropDuplicates(["doc_id", "digest"])


def files_as_they_come(spark: SparkSession, path: str, schema, pattern: str) -> DataFrame:
    """Stream of the Parquet files that match ``pattern``, whatever their times say."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return source.option("maxFileAge", "36500d").parquet(path)


def table_as_it_comes(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of the Parquet table at ``path``, one file or a folder of files, whatever their times say.

    The path is given as a pattern that only it matches: a stream lists a pattern's file, or the files of its folder.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(pattern)


def once_only(batch: DataFrame, number: int, seen: KeyedTable) -> DataFrame:
    """Documents of a batch that no earlier batch had, each once; what is new is noted in ``seen``.

    Equality is that of id and text digest. Only (id, digest) pairs are shuffled and joined; texts are moved only
    if their document occurs twice in the batch. The table notes the batch, so a batch that runs again after a
    failure finds its own documents new once more. Documents without an id are always new.
    """
    rows = batch.withColumn("digest", F.coalesce(F.md5("text"), F.lit("null")))
    keys = rows.where("doc_id is not null").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    earlier = seen.of(keys).where(F.col("batch") < number)
    fresh = cut_lineage(keys.join(earlier, ["doc_id", "digest"], "left_anti"))
    seen.merge(fresh.select("doc_id", "digest", F.lit(number).cast("long").alias("batch")))
    single = rows.join(fresh.where("copies = 1").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    several = rows.join(fresh.where("copies > 1").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    nameless = rows.where("doc_id is null")
    return single.unionByName(several.dropDuplicates(["doc_id", "digest"])).unionByName(nameless).select(batch.columns)


def seen_documents(spark: SparkSession, path: str, kind: str = "bigint", buckets: int = BUCKETS) -> KeyedTable:
    """The documents taken so far; a document keeps the first batch that had it."""
    return KeyedTable(spark, path, f"doc_id {kind}, digest string, batch bigint", ["doc_id", "digest"], ["batch"], buckets, first=True)


def take_in(docs: DataFrame, work: Callable[[DataFrame], DataFrame], base: str, buckets: int = BUCKETS) -> DataFrame:
    """``work`` on every document of a stream once, as a table. The stream keeps no state: the documents seen are
    a stored table of which a batch reads the buckets it needs. Rows are stored by batch, so a repeated batch
    replaces its own."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = seen_documents(spark, f"{base}/seen", kind, buckets)

    def step(batch: DataFrame, number: int) -> None:
        work(once_only(batch, number, seen)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = docs.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    query.start().awaitTermination()
    schema = work(docs).schema
    try:
        rows = spark.read.schema(schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)  # nothing has arrived yet
    return rows.select(schema.names)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet table of the shared folder, and read it."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def extract_stream(docs: DataFrame) -> DataFrame:
    """Mentions of arriving documents; the extraction itself holds no state."""
    return extract(docs)
