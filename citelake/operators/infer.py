"""Inference: concepts of a document to norms it does not cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.operators.joins import join_hot, left_join_hot
from citelake.operators.laws import concepts_in


def detect_concepts(docs: DataFrame, concepts: list[str], cited: DataFrame | None = None, concept_laws: DataFrame | None = None) -> DataFrame:
    """Concepts found in the whole text. A concept whose law the document cites is left out.

    ``cited(doc_id, boe_id)`` and ``concept_laws(concept, boe_id)`` say which concepts are covered; with them
    there is one row per document and concept. Only laws of concepts found in a document are looked up among its
    citations, so a much-cited law is no key of its own.
    """
    found = docs.select("doc_id", F.explode(F.array_distinct(concepts_in(F.col("text"), concepts))).alias("concept"))
    if cited is None or concept_laws is None:
        return found
    laws = concept_laws.select(F.col("concept").alias("__concept"), "boe_id").distinct()
    asked = left_join_hot(found, laws, {"concept": "__concept"}, "doc_id")
    known = cited.select("doc_id", "boe_id").distinct().withColumn("__cited", F.lit(1))
    marked = asked.join(known, ["doc_id", "boe_id"], "left").groupBy("doc_id", "concept").agg(F.max("__cited").alias("__cited"))
    return marked.where(F.col("__cited").isNull()).drop("__cited")


def spread_ranges(concept_map: DataFrame, minimum: int = 70) -> DataFrame:
    """One row per concept and article of its range.

    ``concept_map(concept, law, boe_id, first_article, last_article, confidence)``; entries below
    ``minimum`` confidence or without numeric bounds are left out.
    """
    first, last = F.col("first_article").try_cast("int"), F.col("last_article").try_cast("int")
    usable = concept_map.where((F.col("confidence") >= minimum) & first.isNotNull() & last.isNotNull() & (first <= last))
    articles = F.transform(F.sequence(first, last), lambda n: n.cast("string"))
    return usable.select("concept", "law", "boe_id", "confidence", F.explode(articles).alias("article"))


def concept_ranges(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Article ranges of the concepts found in each document."""
    return join_hot(found, ranges.withColumnRenamed("concept", "__concept"), {"concept": "__concept"}, "doc_id")


def validate_ranges(ranges: DataFrame, law_articles: DataFrame | None, share: float = 0.5) -> DataFrame:
    """Keep articles that exist, where at least ``share`` of the range does. Without an index all stay.

    The check depends on concept and law only: make it on the ranges, before documents are joined.
    """
    if law_articles is None:
        return ranges
    real = law_articles.select("boe_id", F.col("number").alias("article")).distinct().withColumn("__real", F.lit(1))
    marked = ranges.join(real, ["boe_id", "article"], "left")
    good = marked.groupBy("concept", "boe_id").agg(
        (F.count("__real") / F.count(F.lit(1))).alias("__share"), F.count("__real").alias("__n")
    ).where((F.col("__n") > 0) & (F.col("__share") >= share))
    return marked.where(F.col("__real").isNotNull()).join(good, ["concept", "boe_id"], "left_semi").drop("__real")


def new_only(inferred: DataFrame, cited: DataFrame, share: float = 0.5) -> DataFrame:
    """Drop articles the document already cites; a concept stays when at least ``share`` is new."""
    known = cited.select("doc_id", "boe_id", "article").distinct().withColumn("__known", F.lit(1))
    marked = inferred.join(known, ["doc_id", "boe_id", "article"], "left")
    enough = marked.groupBy("doc_id", "concept", "boe_id").agg(
        F.count("__known").alias("__old"), F.count(F.lit(1)).alias("__all")
    ).where(F.col("__all") - F.col("__old") >= share * F.col("__all")).select("doc_id", "concept", "boe_id")
    fresh = marked.where(F.col("__known").isNull()).drop("__known")
    return fresh.join(enough, ["doc_id", "concept", "boe_id"], "left_semi")
