"""Normalisation: acronyms, law formats, EU acts, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions import legal
from citelake.functions.text import FOLD, first_group
from citelake.operators.joins import join_hot, left_join_hot


def alias_dictionary(rows: DataFrame) -> DataFrame:
    """Acronym rows ``(alias, meaning, pos)`` to a multi-map: one row per key and meaning, in order.

    Keys are upper case without dots; blanks are dropped; ``meanings`` counts the key's meanings.
    """
    clean = rows.select(
        F.replace(F.upper(F.trim("alias")), F.lit("."), F.lit("")).alias("alias"),
        F.trim("meaning").alias("meaning"),
        "pos",
    ).where((F.col("alias") != "") & (F.col("meaning") != ""))
    distinct = clean.groupBy("alias", "meaning").agg(F.min("pos").alias("ord"))
    counts = distinct.groupBy("alias").agg(F.count(F.lit(1)).alias("meanings"))
    return distinct.join(counts, "alias")


def alias_laws(rows: DataFrame) -> DataFrame:
    """Acronyms of numbered laws: the priority entries, then rows whose meaning holds a law number."""
    priority = dims.small_table(
        rows.sparkSession,
        [(a, law, title, boe_id, "alta", i) for i, (a, (law, title, boe_id)) in enumerate(dims.PRIORITY_ACRONYMS.items())],
        "alias string, law string, description string, boe_id string, priority string, ord bigint",
    )
    law = first_group(F.col("meaning"), r"(Ley\s+(?:Orgánica\s+)?\d+/\d{4})")
    others = (
        rows.select(
            F.trim("alias").alias("alias"),
            law.alias("law"),
            F.trim("meaning").alias("description"),
            F.lit(None).cast("string").alias("boe_id"),
            F.lit("media").alias("priority"),
            (F.col("pos") + len(dims.PRIORITY_ACRONYMS)).cast("bigint").alias("ord"),
        )
        .where(F.col("law").isNotNull() & (F.col("alias") != ""))
        .join(F.broadcast(priority.select("alias")), "alias", "left_anti")
    )
    return priority.unionByName(others)


def acronym_to_law(mentions: DataFrame, laws: DataFrame) -> DataFrame:
    """Law of an acronym in any case; of several entries the first wins."""
    first = laws.groupBy(F.upper(F.trim("alias")).alias("__k")).agg(F.min_by("law", "ord").alias("alias_law"))
    keyed = mentions.withColumn("__key", F.upper(F.trim("text")))
    return left_join_hot(keyed, first.where(F.col("__k").isNotNull()), {"__key": "__k"}, "mention_id").drop("__key")


def acronym_key(text: Column) -> Column:
    return F.replace(F.upper(F.trim(text)), F.lit("."), F.lit(""))


def expand_acronyms(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Meaning of an acronym mention ``(mention_id, kind, text, context)``.

    With several meanings the one that shares most words with the context is taken, then the
    earliest. The choice is made once per (acronym, context), and a law number inside the meaning
    becomes the mention's law.
    """
    keyed = mentions.withColumn("__key", F.when(legal.is_acronym(F.col("kind"), F.col("text")), acronym_key(F.col("text"))))
    asked = keyed.where(F.col("__key").isNotNull()).select("__key", "context").distinct()

    def words(c: Column) -> Column:
        return F.array_distinct(F.split(F.lower(c), r"[\s,]+"))

    known = dictionary.where(F.col("alias").isNotNull())
    scored = join_hot(asked, known, {"__key": "alias"}, "context").withColumn(
        "__score", F.size(F.array_intersect(words(F.col("meaning")), words(F.coalesce("context", F.lit("")))))
    )
    best = scored.groupBy(F.col("__key").alias("__k"), F.col("context").alias("__c")).agg(
        F.min_by("meaning", F.struct(-F.col("__score"), F.col("ord"), F.col("meaning"))).alias("meaning"),
        F.max("meanings").alias("meanings"),
    )
    joined = left_join_hot(keyed, best, {"__key": "__k", "context": "__c"}, "mention_id")
    return joined.select(
        *mentions.columns,
        F.when(F.col("meaning").isNotNull(), F.col("__key")).alias("acronym"),
        "meaning",
        (F.coalesce("meanings", F.lit(0)) > 1).alias("ambiguous"),
        first_group(F.col("meaning"), r"(Ley\s+(?:Orgánica\s+)?\d+/\d{4})").alias("meaning_law"),
    )


def normalize_law(mentions: DataFrame) -> DataFrame:
    """Canonical law string and law type; the text stands in where the law lacks its type word."""
    by_law, law_type = legal.law_form(F.col("law"))
    by_text, text_type = legal.law_form(F.col("text"))
    return mentions.withColumn("law_norm", F.coalesce(by_law, by_text)).withColumn(
        "law_type", F.coalesce(law_type, text_type)
    )


_ARTICLE_HEAD = FOLD + r"art(?:ículo|iculo)?\.?\s*\d+\s+del?\s+"
_ARTICLE_NO = FOLD + r"art(?:ículo|iculo)?\.?\s*(\d+)"


def normalize_eu(mentions: DataFrame) -> DataFrame:
    """EU acts: known acronym, informal form or standard form, with CELEX and normal text."""
    text = F.col("text")
    # intermediate results are columns of their own: each is read several times below
    staged = mentions.withColumn("__eu", F.coalesce(legal.is_eu(text), F.lit(False))).withColumn(
        "__bare", F.trim(F.regexp_replace(F.trim(text), _ARTICLE_HEAD, ""))
    )
    staged = staged.withColumn("__informal", legal.eu_informal(F.col("__bare")))
    staged = dims.lookup(staged, dims.EU_ACRONYMS, F.col("__bare"), "__name")
    staged = dims.lookup(staged, dims.EU_CELEX, F.col("__bare"), "__known")
    staged = staged.withColumn("__article", first_group(text, _ARTICLE_NO)).withColumn(
        "__celex",
        F.when(
            F.col("__eu"),
            F.coalesce(F.col("__known"), legal.derive_celex(F.coalesce(F.col("__informal"), text))),
        ),
    )
    changed = F.col("__celex").isNotNull()
    act = F.coalesce("__name", "__informal")
    with_article = F.concat(F.lit("Artículo "), F.col("__article"), F.lit(" del "), act)
    return staged.select(
        *mentions.columns,
        F.col("__eu").alias("is_eu"),
        F.col("__celex").alias("celex"),
        F.when(changed & F.col("__name").isNotNull(), F.col("__bare")).alias("eu_acronym"),
        F.when(changed, F.col("__article")).alias("eu_article"),
        F.when(changed, F.coalesce(with_article, act, text)).alias("normal_text"),
    )


def process_names(mentions: DataFrame, column: str = "law") -> DataFrame:
    """What is known of a law name: expansion, acronym and EU flags, registry id, CELEX."""
    name = F.col(column)
    out = dims.lookup(mentions, dims.EU_ACRONYMS, name, "__eu")
    out = dims.lookup(out, dims.LAW_ACRONYMS, name, "__es")
    out = dims.lookup(out, dims.EU_CELEX, name, "celex")
    out = dims.lookup(out, dims.ACRONYM_REGISTRY_ID, name, "__id")
    return out.select(
        *mentions.columns,
        F.coalesce("__eu", "__es", name).alias("expanded"),
        (F.col("__eu").isNotNull() | F.col("__es").isNotNull()).alias("acronym_known"),
        F.when(F.col("__eu").isNotNull(), F.lit(True))
        .when(F.col("__es").isNotNull(), F.lit(False))
        .otherwise(F.coalesce(legal.is_eu(name), F.lit(False)))
        .alias("is_eu"),
        F.when(F.col("__eu").isNull() & F.col("__es").isNotNull(), F.col("__id")).alias("boe_id"),
        F.col("celex"),
    )


def categorize(mentions: DataFrame) -> DataFrame:
    return (
        mentions.withColumn("category", legal.category(F.col("kind")))
        .withColumn("has_id", F.coalesce(F.col("boe_id") != "", F.lit(False)))
        .withColumn("has_article", F.coalesce(F.col("article") != "", F.lit(False)))
    )


def normalize_mentions(mentions: DataFrame) -> DataFrame:
    """The whole stage: EU acts first; other mentions get their acronym's law and the law format."""
    staged = normalize_eu(mentions)
    staged = dims.lookup(staged, dims.acronym_laws(), acronym_key(F.col("text")), "__alias")
    es = F.col("celex").isNull()
    acronym = legal.is_acronym(F.col("kind"), F.col("text"))
    staged = staged.withColumn("__law", F.when(acronym & es, F.coalesce("__alias", "law")).otherwise(F.col("law")))
    by_law, law_type = legal.law_form(F.col("__law"))
    by_text, text_type = legal.law_form(F.col("text"))
    staged = staged.withColumn("law_norm", F.when(es, F.coalesce(by_law, by_text))).withColumn(
        "law_type", F.when(es, F.coalesce(law_type, text_type))
    )
    expanded = acronym & es & F.col("__alias").isNotNull()
    changed = F.col("celex").isNotNull() | expanded | F.col("law_norm").isNotNull()
    return staged.select(
        *[c for c in mentions.columns if c != "law"],
        F.col("__law").alias("law"),
        "is_eu",
        "celex",
        "normal_text",
        "law_norm",
        "law_type",
        legal.category(F.col("kind")).alias("category"),
        expanded.alias("expanded"),
        changed.alias("normalized"),
    )


def eu_urls(acts: DataFrame, languages: list[str] = dims.EU_LANGUAGES) -> DataFrame:
    """Links of every act in every language: text, PDF, all formats, main."""
    fanned = acts.withColumn("language", F.explode(F.array(*[F.lit(x) for x in languages])))
    celex, language = F.col("celex"), F.col("language")
    return fanned.select(
        *acts.columns,
        "language",
        legal.eu_url(celex, language).alias("txt"),
        legal.eu_url(celex, language, "PDF").alias("pdf"),
        legal.eu_url(celex, language, "ALL").alias("html"),
        legal.eu_url(celex, language).alias("main"),
    )
