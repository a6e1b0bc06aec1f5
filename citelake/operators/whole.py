"""The whole way from documents to mentions that are ready for consensus, audit and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.legal import canonical_key, law_form, normalize_article
from citelake.functions.text import FOLD, first_group, none_if_empty
from citelake.operators import dedupe, extract, filters, normalize, registry, resolve
from citelake.operators.joins import join_hot, left_join_hot
from citelake.session import cut_lineage

_EU_ARTICLE = FOLD + r"^art(?:ículo|iculo|\.)?\s+(\d+)\s+del?\s"
_EU_CONFIDENCE = 95


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256))


def _hits(parts: DataFrame) -> DataFrame:
    """Mentions, EU acts and articles with their law of all stretches, told apart by ``rule``. A rule sees each distinct text of
    a stretch once; a digest stands for the text, since a long one would travel with each of its many mentions. ``form`` is the
    law in the form in which a document's laws are counted."""
    texts = cut_lineage(parts.select("text").distinct())
    once = texts.select(_digest().alias("doc_id"), F.lit(0).alias("at"), "text")
    found = extract.drop_noise(extract.extract(once)).withColumn("rule", F.lit("mention"))
    acts = extract.extract_eu(once).withColumn("rule", F.lit("act")).withColumn("article", first_group(F.col("text"), _EU_ARTICLE))
    by_law = extract.extract_article_law(once).withColumn("rule", F.lit("law"))
    form = F.coalesce(law_form(F.col("law"))[0], law_form(F.col("text"))[0], F.col("law"))
    answers = found.unionByName(acts, True).unionByName(by_law, True).select(
        F.col("doc_id").alias("__of"), F.col("start").alias("__start"), "rule", "agent", "kind", "text", "law", "article", "confidence",
        F.when(F.col("law").isNotNull(), form).alias("form"),
    )
    placed = join_hot(parts.select("doc_id", "at", _digest().alias("__digest")), answers, {"__digest": "__of"}, ["doc_id", "at"])
    return placed.withColumn("start", F.col("at") + F.col("__start")).drop("__digest", "at", "__start")


def with_acts(hits: DataFrame) -> DataFrame:
    """Mentions plus those of EU acts, and articles with the law or the act they stand in front of.

    An article takes the law named right after it; one that begins the mention of an EU act takes the whole
    text of that mention. The articles that are left take the document's principal law, where there is one.
    ``found`` is the text that a rule matched, which names the mention.
    """
    columns = ["doc_id", "agent", "kind", F.col("text").alias("found"), "text", "law", "article", "confidence", "start", "form"]
    mentions, acts, by_law = (hits.where(F.col("rule") == rule) for rule in ("mention", "act", "law"))
    by_law = by_law.select("doc_id", "start", F.col("law").alias("__law"), F.col("form").alias("__form"))
    places = by_law.join(acts.select("doc_id", "start", F.col("text").alias("__act")), ["doc_id", "start"], "full")
    own = acts.withColumns({"agent": F.lit("C"), "kind": F.lit("reglamento"), "confidence": F.lit(_EU_CONFIDENCE)})
    # no other mention begins where an article or an act does
    article = F.col("kind") == "articulo"
    of_act = F.col("__act").isNotNull()
    placed = mentions.where(article).select(*columns).join(places, ["doc_id", "start"], "left").withColumns({
        "text": F.coalesce("__act", "text"),
        "law": F.when(of_act, F.col("law")).otherwise(F.coalesce("law", "__law")),
        "form": F.when(of_act, F.col("form")).otherwise(F.coalesce("form", "__form")),
        "__eu": of_act,
    }).drop("__act", "__law", "__form")
    others = mentions.where(~article).select(*columns, F.lit(False).alias("__eu"))
    rows = cut_lineage(placed.unionByName(others).unionByName(own.select(*columns, F.lit(True).alias("__eu"))))
    lawful = rows.where(F.col("law").isNotNull()).select("doc_id", F.col("form").alias("law"))
    principal = resolve.principal_law(lawful).select("doc_id", "principal_law")
    bare = article & ~F.col("__eu") & F.col("law").isNull()
    led = rows.where(bare).join(principal, "doc_id", "left").withColumn("law", F.col("principal_law")).drop("principal_law")
    return rows.where(~bare).unionByName(led).drop("__eu", "form")


#: what the normal form, the registry id and the validation of a mention depend on
_ASKED = ["kind", "text", "law", "article"]


def _judged(mentions: DataFrame, law_articles: DataFrame | None) -> DataFrame:
    """Mentions with normal form, CELEX, registry id and validation, worked out once per distinct kind, text, law and article."""
    keys = {c: f"asked_{c}" for c in _ASKED}
    asked = cut_lineage(mentions.select(*_ASKED).distinct())
    named = asked.select("*", *[F.col(c).alias(k) for c, k in keys.items()], F.xxhash64(*_ASKED).alias("mention_id"))
    valid = registry.validate_mentions(normalize.normalize_mentions(named), law_articles)
    answers = valid.drop("mention_id", "kind", "text", "article")
    rows = mentions.withColumnRenamed("law", "__named")
    return left_join_hot(rows, answers, {"__named" if c == "law" else c: k for c, k in keys.items()}, ["doc_id", "start"]).drop("__named")


def mention_key() -> Column:
    """Law and article; an article of an unknown law is known by its own place."""
    law = canonical_key(F.col("boe_id"), F.coalesce("celex", "law_norm", "law"), F.lit(None).cast("string"))
    article = none_if_empty(normalize_article(F.col("article")))
    place = F.when(law == "", F.concat(F.lit("@"), F.col("start").cast("string"))).otherwise(F.lit(""))
    return F.when(article.isNull(), law).otherwise(F.concat(law, F.lit(":art"), article, place))


def found_mentions(docs: DataFrame, law_articles: DataFrame | None = None) -> DataFrame:
    """Mentions of all profiles and of EU acts with normal form, CELEX, registry id, validation and ``key``.

    ``docs(doc_id, text)``. The texts are walked once, for their stretches. Noise goes first. An EU act with a CELEX is
    valid. Mentions are written before the last join alone: who reads the result more than once writes what is read.
    """
    parts = cut_lineage(extract.stretches(docs))
    valid = _judged(with_acts(cut_lineage(_hits(parts))), law_articles)
    act = F.col("celex").isNotNull()
    valid = valid.withColumn("validated", F.col("validated") | act).withColumn("reason", F.when(~act, F.col("reason")))
    identity = extract.mention_id(*[F.col(c) for c in ("doc_id", "agent", "kind", "start", "found")])
    return valid.withColumn("key", mention_key()).withColumn("mention_id", identity).drop("found")


def accepted(found: DataFrame, minimum: int = 70) -> DataFrame:
    """Mentions above the threshold, one per document and key; profile A before B before C."""
    order = [dedupe.agent_rank(F.col("agent")), F.col("start"), F.col("mention_id")]
    return dedupe.keep_first(filters.threshold(found, minimum, 100), ["doc_id", "key"], order)
