"""A training corpus from raw documents: filter, join near copies, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a table;
the driver or ``run`` writes it as Parquet and reads it back for the next stage. All stages but the last
return the columns of ``documents``; the last adds ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citelake.llm import contamination, jaccard, mixing, quality, sharding
from citelake.llm.store import Scratch, short_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    short_batches(spark)
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    short_batches(spark)
    return jaccard.drop_near_copies(docs, jaccard.NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leaked benchmark item go."""
    short_batches(spark)
    return contamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.place(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", shards),
]

#: Connected components and subset sums are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES:
        out = scratch.put(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        docs = last = out
    return docs
