"""Row filters, search, sort, top-k and result projection over mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelake.functions.legal import is_exportable, registry_url


def threshold(mentions: DataFrame, minimum: int, missing: int) -> DataFrame:
    """Mentions of at least ``minimum`` confidence; ``missing`` stands in for an absent one."""
    return mentions.where(F.coalesce("confidence", F.lit(missing)) >= minimum)


def threshold_counts(mentions: DataFrame, minimum: int, missing: int) -> DataFrame:
    kept = F.coalesce("confidence", F.lit(missing)) >= minimum
    return mentions.groupBy("doc_id").agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped")
    )


def exportable(mentions: DataFrame) -> DataFrame:
    return mentions.where(is_exportable(F.col("boe_id"), F.col("text")))


def search(mentions: DataFrame, term: str) -> DataFrame:
    """Mentions whose text, law or article contains ``term`` in any case."""
    hits = [F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in ("text", "law", "article")]
    return mentions.where(reduce(Column.__or__, hits))


def distinct_kinds(mentions: DataFrame) -> DataFrame:
    return mentions.select("kind").distinct().orderBy("kind")


def sort_mentions(mentions: DataFrame, by: str = "confidence", ascending: bool = False) -> DataFrame:
    empty = F.lit(0) if by == "confidence" else F.lit("")
    key = F.coalesce(by, empty)
    return mentions.orderBy(key.asc() if ascending else key.desc(), "mention_id")


def top_k(mentions: DataFrame, k: int) -> DataFrame:
    """The k most confident mentions of each document. The limit is applied before the shuffle too."""
    order = W.partitionBy("doc_id").orderBy(F.coalesce("confidence", F.lit(0)).desc(), "mention_id")
    return mentions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def project_result(mentions: DataFrame) -> DataFrame:
    """The public result columns, with the registry link of the mention."""
    return mentions.select(
        "doc_id",
        "mention_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("kind", F.lit("desconocido")).alias("kind"),
        "law",
        "article",
        F.coalesce("confidence", F.lit(0)).alias("confidence"),
        F.coalesce("validated", F.lit(False)).alias("validated"),
        "boe_id",
        F.col("agent").alias("found_by"),
        registry_url(F.col("boe_id")).alias("boe_url"),
        registry_url(F.col("boe_id"), F.col("article")).alias("article_url"),
    )


def split_incomplete(mentions: DataFrame) -> DataFrame:
    """Flag of mentions that still need resolution: less than full confidence."""
    return mentions.withColumn("incomplete", F.coalesce("confidence", F.lit(100)) < 100)
