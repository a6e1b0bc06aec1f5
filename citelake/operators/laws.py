"""The law corpus: block types, hierarchy, articles, concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import bind, first_group
from citelake.operators.ordered import fill_forward


def block_type(block_id: Column) -> Column:
    low = F.lower(block_id)
    return (
        F.when(low.rlike(r"^a\d+"), F.lit("articulo"))
        .when(low.rlike(r"^t(?:preliminar|[ivxlcdm]+)$"), F.lit("titulo"))
        .when(low.rlike(r"^l[ivxlcdm]+$"), F.lit("libro"))
        .when(low.rlike(r"^c[ivxlcdm]+$"), F.lit("capitulo"))
        .when(low.rlike(r"^s[ivxlcdm]+$"), F.lit("seccion"))
        .otherwise(F.lit("otro"))
    )


def article_number(block_title: Column, block_id: Column) -> Column:
    """Number from the title, else from the id."""
    return F.coalesce(
        first_group(block_title, r"[Aa]rt[íi]culo\s+(\d+(?:\.\d+)?)"), first_group(block_id, r"a(\d+)")
    )


def hierarchy(blocks: DataFrame, width: int) -> DataFrame:
    """Every block with the title it stands under; null before the first title of its law."""
    typed = blocks.withColumn("block_type", block_type(F.col("block_id")))
    heading = F.when(
        F.col("block_type") == "titulo",
        F.struct(F.col("pos").alias("title_pos"), F.col("block_title").alias("title")),
    )
    filled = fill_forward(typed, ["boe_id"], "pos", heading, "__title", width, inclusive=True)
    return filled.select(
        *blocks.columns, "block_type", F.col("__title.title_pos").alias("title_pos"), F.col("__title.title").alias("title")
    )


def articles_flat(blocks: DataFrame, width: int, drop_orphans: bool = False) -> DataFrame:
    """All articles of all laws with number and parent title."""
    placed = hierarchy(blocks, width).where(F.col("block_type") == "articulo")
    numbered = placed.withColumn("number", article_number(F.col("block_title"), F.col("block_id"))).where(
        F.col("number").isNotNull()
    )
    if drop_orphans:
        numbered = numbered.where(F.col("title").isNotNull())
    return numbered.select("boe_id", "pos", "block_id", "number", F.col("block_title").alias("name"), "title_pos", "title")


def concepts_in(text: Column, concepts: list[str]) -> Column:
    """Concepts of a dictionary that a text contains, in any case. The dictionary is a literal."""
    words = F.array(*[F.lit(c.lower()) for c in concepts])
    return bind(F.lower(text), lambda low: F.filter(words, lambda c: low.contains(c)))


def concept_to_articles(articles: DataFrame, concepts: list[str]) -> DataFrame:
    """Articles of a concept, per law.

    The first title that contains the concept gives all its articles (90); where no title does,
    articles whose name contains it are taken (70). One row per law, concept and article.
    """
    in_title = articles.where(F.col("title").isNotNull()).select(
        "boe_id", F.explode(concepts_in(F.col("title"), concepts)).alias("concept"), "title_pos", "title"
    )
    first_title = in_title.groupBy("boe_id", "concept").agg(
        F.min("title_pos").alias("title_pos"), F.min_by("title", "title_pos").alias("found_in")
    )
    by_title = articles.join(first_title, ["boe_id", "title_pos"]).select(
        "boe_id", "concept", "pos", "number", "found_in", F.lit("titulo").alias("match_type"), F.lit(90).alias("confidence")
    )
    in_name = articles.select("boe_id", "pos", "number", F.explode(concepts_in(F.col("name"), concepts)).alias("concept"))
    by_name = in_name.join(first_title, ["boe_id", "concept"], "left_anti").select(
        "boe_id", "concept", "pos", "number",
        F.concat(F.lit('Artículos relacionados con "'), F.col("concept"), F.lit('"')).alias("found_in"),
        F.lit("articulo").alias("match_type"), F.lit(70).alias("confidence"),
    )
    return by_title.unionByName(by_name)


def index_stats(articles: DataFrame) -> DataFrame:
    """Titles that hold articles, articles, first and last article of each law."""
    return articles.groupBy("boe_id").agg(
        F.countDistinct("title_pos").alias("titles"),
        F.count(F.lit(1)).alias("articles"),
        F.min_by("number", "pos").alias("first_article"),
        F.max_by("number", "pos").alias("last_article"),
    )
