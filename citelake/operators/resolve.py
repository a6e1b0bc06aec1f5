"""Mentions that need their document: principal law, pointers back, external resolutions, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.text import rounded
from citelake.operators.ordered import fill_forward, number_rows


def principal_law(mentions: DataFrame, min_share: int = 80) -> DataFrame:
    """The law a document mentions most; named only when it has ``min_share`` percent of all."""
    counts = mentions.where(F.col("law").isNotNull()).groupBy("doc_id", "law").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("doc_id").agg(
        F.min_by("law", F.struct(-F.col("n"), F.col("law"))).alias("top_law"),
        F.max("n").alias("top_count"),
        F.sum("n").alias("law_mentions"),
    )
    share = F.floor(100 * F.col("top_count") / F.col("law_mentions")).cast("int")
    return top.withColumn("confidence", share).withColumn(
        "principal_law", F.when(share >= min_share, F.col("top_law"))
    )


def second_pass(mentions: DataFrame, principals: DataFrame) -> DataFrame:
    """Mentions without a law take the document's principal law; near-certain ones become certain."""
    joined = mentions.join(principals.select("doc_id", "principal_law"), "doc_id", "left")
    fits = F.col("law").isNull() & F.col("principal_law").isNotNull()
    confidence = F.coalesce("confidence", F.lit(0))
    return joined.select(
        "doc_id",
        "mention_id",
        F.when(fits, F.col("principal_law")).otherwise(F.col("law")).alias("law"),
        F.when(fits, F.lit(100)).when(confidence >= 95, F.lit(100)).otherwise(confidence).alias("confidence"),
        fits.alias("resolved"),
    )


def resolve_pointers(stream: DataFrame, width: int) -> DataFrame:
    """Give each pointer the nearest law named before it. ``stream(doc_id, start, law, …)``."""
    return fill_forward(stream, ["doc_id"], "start", F.col("law"), "resolved_law", width)


def previous_article(mentions: DataFrame, width: int) -> DataFrame:
    """The article named last before this mention."""
    return fill_forward(mentions, ["doc_id"], "start", F.col("article"), "previous_article", width)


def batches(mentions: DataFrame, size: int, width: int) -> DataFrame:
    """Number the mentions of a document and cut them into batches: batch_id and 1-based idx."""
    numbered = number_rows(mentions, ["doc_id"], "start", "__n", width, ties=("agent", "mention_id"))
    return numbered.select(
        *mentions.columns,
        F.floor((F.col("__n") - 1) / size).cast("int").alias("batch_id"),
        ((F.col("__n") - 1) % size + 1).cast("int").alias("idx"),
    )


def apply_resolutions(batched: DataFrame, answers: DataFrame, default_confidence: int = 90) -> DataFrame:
    """Join answers ``(doc_id, batch_id, idx, law, confidence, reason)`` back by position. The confidence that a mention
    had stays beside the new one as ``before``."""
    a = answers.select(
        "doc_id", "batch_id", "idx",
        F.col("law").alias("__law"), F.col("confidence").alias("__conf"), F.col("reason").alias("reason"),
        F.lit(True).alias("__hit"),
    )
    joined = batched.join(a, ["doc_id", "batch_id", "idx"], "left")
    hit = F.coalesce("__hit", F.lit(False)) & F.col("__law").isNotNull()
    return joined.select(
        "doc_id", "mention_id", "batch_id", "idx",
        F.when(hit, F.col("__law")).otherwise(F.col("law")).alias("law"),
        F.when(hit, F.coalesce("__conf", F.lit(default_confidence))).otherwise(F.col("confidence")).alias("confidence"),
        hit.alias("resolved"),
        F.when(hit, F.col("reason")).alias("reason"),
        F.col("confidence").alias("before"),
    )


def resolution_metrics(before: Column, after: Column, resolved: Column) -> list[Column]:
    """Aggregates over mentions that were incomplete: counts, and mean confidence before and after."""
    incomplete = F.coalesce(before, F.lit(100)) < 100
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(incomplete).alias("incomplete"),
        F.count_if(incomplete & resolved).alias("resolved"),
        rounded(F.avg(F.when(incomplete, before)), 6).alias("confidence_before"),
        rounded(F.avg(F.when(incomplete, F.coalesce(after, F.lit(100)))), 6).alias("confidence_after"),
    ]


def resolve_titles(mentions: DataFrame) -> DataFrame:
    """Official title by acronym or law number; the hint text has confidence 90, a full title 100."""
    key = F.upper(F.trim(F.coalesce("law", "text")))
    titled = dims.lookup(mentions, dims.law_titles(), key, "title")
    exact = key.isin(*[k for k in _full_titles()])
    return titled.withColumn("title_resolved", F.col("title").isNotNull()).withColumn(
        "title_confidence", F.when(F.col("title").isNull(), F.lit(0)).when(exact, F.lit(100)).otherwise(F.lit(90))
    )


def _full_titles() -> list[str]:
    keys = []
    for acronym, (law, _title, _id) in dims.PRIORITY_ACRONYMS.items():
        keys += [acronym.upper(), law.upper()]
    return sorted(set(keys))
