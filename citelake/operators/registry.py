"""Registry lookups and validation of mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions import legal
from citelake.functions.text import FOLD, first_group, none_if_empty, rounded
from citelake.operators.joins import left_join_hot


def extract_law_info(mentions: DataFrame) -> DataFrame:
    """Law reference of a mention (normal form, law, or found in the text) and its year."""
    ref = F.coalesce(none_if_empty(F.col("law_norm")), none_if_empty(F.col("law")), legal.law_in_text(F.col("text")))
    return mentions.withColumn("ref", ref).withColumn("ref_year", first_group(F.col("ref"), r"(\d{4})").cast("int"))


def registry_ids(refs: DataFrame) -> DataFrame:
    """Registry id of ``refs(ref, title)``: name, then title, then type and number.

    Each step is an equi-join with a dictionary of fixed size; together they run in one stage.
    """
    registry = dims.registry_entries()
    out = refs.withColumn("__clean", legal.clean_reference(F.col("ref")))
    out = dims.lookup(out, registry, F.lower(F.trim("ref")), "__by_name")
    out = dims.lookup(out, registry, legal.numbered_key(F.col("title")), "__by_title")
    word = F.coalesce(*[
        F.when(F.lower("title").contains(w), F.lit(boe_id)) for w, boe_id in dims.TITLE_REGISTRY.items()
    ])
    out = dims.lookup(out, registry, legal.numbered_key(F.col("__clean")), "__by_number")
    return out.select(
        *refs.columns,
        F.coalesce("__by_name", "__by_title", word, "__by_number").alias("boe_id"),
        F.when(F.col("__by_name").isNotNull(), F.lit("name"))
        .when(F.coalesce(F.col("__by_title"), word).isNotNull(), F.lit("title"))
        .when(F.col("__by_number").isNotNull(), F.lit("number"))
        .alias("found_by"),
    )


def bulk_lookup(mentions: DataFrame) -> DataFrame:
    """Look up each distinct reference once and join the answers back."""
    answers = registry_ids(mentions.select("ref", "title").distinct()).select(
        F.col("ref").alias("__ref"), F.col("title").alias("__title"), "boe_id", "found_by"
    )
    return left_join_hot(mentions, answers, {"ref": "__ref", "title": "__title"}, "mention_id")


def registry_year_range(refs: DataFrame, registry: DataFrame, years: int = 30) -> DataFrame:
    """Newest entry of the same type and number within ``years`` up to the reference's year.

    The registry is first brought to one entry per type, number and year, and then to one row per
    type and number with its years in an array, which holds at most one element per calendar year.
    The join is a plain equi-join of distinct references and never builds pairs.
    """
    yearly = registry.groupBy("law_type", "number", "year").agg(F.min("boe_id").alias("boe_id"))
    index = yearly.groupBy("law_type", "number").agg(F.collect_list(F.struct("year", "boe_id")).alias("__years"))
    asked = refs.select("law_type", "number", "ref_year").distinct()
    in_range = F.filter("__years", lambda e: (e["year"] <= F.col("ref_year")) & (e["year"] > F.col("ref_year") - years))
    answers = asked.join(index, ["law_type", "number"], "left").select(
        "law_type", "number", "ref_year", F.array_max(in_range).alias("__hit")
    )
    return refs.join(answers, ["law_type", "number", "ref_year"], "left").select(
        *refs.columns, F.col("__hit.year").alias("found_year"), F.col("__hit.boe_id").alias("boe_id")
    )


def registry_index(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """The dictionary and ``registry(law_type, number, year, boe_id)`` as one table (key, boe_id, years).

    ``n:`` keys are names, ``k:`` keys a type with number and year, ``y:`` keys a type and number with all its
    years, at most one entry per calendar year. The dictionary goes before the table.
    """
    fixed = dims.registry_table(spark)
    no_years = F.lit(None).cast("array<struct<year:int,boe_id:string>>").alias("years")
    typed = dims.number_key(F.col("law_type"), F.col("number").cast("string"))
    yearly = registry.groupBy(typed.alias("typed"), F.col("year").cast("int").alias("year")).agg(F.min("boe_id").alias("boe_id"))
    numbered = yearly.select(F.concat(F.lit("k:"), "typed", F.lit("/"), F.col("year").cast("string")).alias("key"), "boe_id")
    known = fixed.select(F.concat(F.lit("k:"), "match_key").alias("key"), "boe_id")
    numbers = known.withColumn("__at", F.lit(0)).union(numbered.withColumn("__at", F.lit(1))).groupBy("key").agg(F.min_by("boe_id", "__at").alias("boe_id"))
    names = fixed.select(F.concat(F.lit("n:"), "match_key").alias("key"), "boe_id", no_years)
    ranges = yearly.groupBy(F.concat(F.lit("y:"), "typed").alias("key")).agg(F.collect_list(F.struct("year", "boe_id")).alias("years"))
    return names.union(numbers.select("key", "boe_id", no_years)).union(ranges.select("key", F.lit(None).cast("string").alias("boe_id"), "years"))


def registry_cascade(refs: DataFrame, registry: DataFrame, latest: int, years: int = 30) -> DataFrame:
    """Registry id of ``refs(ref, title, ref_year)`` by name, title, number and year, newest year in range, pattern.

    The first step that finds an entry wins and ``found_by`` names it. A norm without an entry of its own year is
    looked up by type and number as of ``ref_year`` (``latest`` if there is none), the newest of the last ``years``.
    Steps are not run one after the other: each distinct reference gives its keys with their priorities, one
    equi-join meets the index, and the least priority is kept. Answers are joined back to the rows.
    """
    asked = refs.select("ref", "title", "ref_year").distinct()
    clean = legal.clean_reference(F.col("ref"))
    word = F.coalesce(*[F.when(F.lower("title").contains(w), F.lit(boe_id)) for w, boe_id in dims.TITLE_REGISTRY.items()])
    steps = [
        ("name", "n:", F.lower(F.trim("ref"))),
        ("title", "k:", legal.numbered_key(F.col("title"))),
        ("title", None, word),
        ("number", "k:", legal.numbered_key(clean)),
        ("year", "y:", legal.number_without_year(clean)),
        *[("pattern", "k:", key) for key in legal.plain_numbers(F.col("ref"))],
    ]
    structs = [
        F.struct(
            F.lit(i).alias("priority"), F.lit(name).alias("found_by"),
            (F.concat(F.lit(mark), key) if mark else F.concat(F.lit("="), key)).alias("key"),
            (F.lit(None).cast("string") if mark else key).alias("given"),
        )
        for i, (name, mark, key) in enumerate(steps)
    ]
    keys = asked.select("*", F.inline(F.array(*structs))).where(F.col("key").isNotNull())
    until = F.coalesce("ref_year", F.lit(latest))
    newest = F.array_max(F.filter("years", lambda e: (e["year"] <= until) & (e["year"] > until - years)))
    met = keys.join(registry_index(refs.sparkSession, registry), "key", "left").withColumn("__newest", newest)
    hit = F.coalesce("given", "boe_id", "__newest.boe_id")
    best = F.min_by(F.struct(hit.alias("boe_id"), "found_by", F.col("__newest.year").alias("found_year")), "priority")
    found = met.where(hit.isNotNull()).groupBy("ref", "title", "ref_year").agg(best.alias("b"))
    answers = found.select(*(F.col(c).alias(f"__{c}") for c in ("ref", "title", "ref_year")), "b.boe_id", "b.found_by", "b.found_year")
    return left_join_hot(refs, answers, {c: f"__{c}" for c in ("ref", "title", "ref_year")}, "mention_id")


def check_articles(mentions: DataFrame, law_articles: DataFrame) -> DataFrame:
    """Does the article exist in the law? True, false, or null when the law has no index.

    ``law_articles(boe_id, number)``; leading zeros are dropped, and ``23.2.b`` is checked by the
    article number the index can hold (``23.2``, else ``23``).
    """
    number = F.regexp_replace(legal.normalize_article(F.col("article")), r"^0+", "")
    keyed = mentions.withColumn("article_checked", number).withColumn(
        "__base", F.substring_index("article_checked", ".", 1)
    )
    known = law_articles.select(F.col("boe_id").alias("__law"), F.col("number").alias("__n")).distinct()
    laws = law_articles.select(F.col("boe_id").alias("__law")).distinct()
    by_number = {"boe_id": "__law", "article_checked": "__n"}
    by_base = {"boe_id": "__law", "__base": "__n"}
    joined = left_join_hot(keyed, known.withColumn("__exact", F.lit(True)), by_number, "mention_id")
    joined = left_join_hot(joined, known.withColumn("__has_base", F.lit(True)), by_base, "mention_id")
    joined = left_join_hot(joined, laws.withColumn("__indexed", F.lit(True)), {"boe_id": "__law"}, "mention_id")
    exists = F.when(
        F.col("article").isNotNull() & F.coalesce("__indexed", F.lit(False)),
        F.coalesce("__exact", "__has_base", F.lit(False)),
    )
    return joined.withColumn("article_exists", exists).drop("__exact", "__has_base", "__indexed", "__base")


def hallucinated(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("article_exists"))


def verdict(has_ref: Column, boe_id: Column, article: Column, article_exists: Column) -> tuple[Column, Column]:
    """Validated or not, and the reason why not."""
    missing_article = F.coalesce(~article_exists, F.lit(False))
    validated = has_ref & boe_id.isNotNull() & ~missing_article
    reason = (
        F.when(~has_ref, F.lit("No se pudo extraer información de ley"))
        .when(boe_id.isNull(), F.lit("No se encontró BOE-ID"))
        .when(missing_article, F.concat(F.lit("Artículo "), article, F.lit(" NO existe en el BOE oficial")))
    )
    return validated, reason


def validate_mentions(mentions: DataFrame, law_articles: DataFrame | None = None) -> DataFrame:
    """The validation stage over normalised mentions."""
    with_ref = extract_law_info(mentions)
    if "title" not in with_ref.columns:
        with_ref = with_ref.withColumn("title", F.lit(None).cast("string"))
    # few laws are named very often: look each reference up once
    found = bulk_lookup(with_ref)
    checked = check_articles(found, law_articles) if law_articles is not None else found.withColumn(
        "article_exists", F.lit(None).cast("boolean")
    )
    validated, reason = verdict(F.col("ref").isNotNull(), F.col("boe_id"), F.col("article"), F.col("article_exists"))
    return (
        checked.withColumn("validated", validated)
        .withColumn("reason", reason)
        .withColumn("article_valid", F.when(F.col("article").isNotNull(), legal.article_format_valid(F.col("article"))))
        .withColumn("boe_url", legal.registry_url(F.col("boe_id")))
    )


def validation_stats(mentions: DataFrame, keys: list[str]) -> DataFrame:
    validated = F.coalesce("validated", F.lit(False))
    return mentions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(validated).alias("validated"),
        F.count_if(~validated).alias("not_validated"),
        rounded(F.count_if(validated) / F.count(F.lit(1)), 6).alias("rate"),
        F.count_if(F.coalesce(F.col("boe_id") != "", F.lit(False))).alias("with_id"),
        F.count_if(F.coalesce(legal.article_format_valid(F.col("article")), F.lit(False))).alias("with_valid_article"),
    )


#: an article's number inside a block title, in any of the usual forms
TITLE_ARTICLE = FOLD + r"Art(?:[ií]culo|\.)\s*(\d+(?:\.\d+)?)\b"


def article_texts(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block of an article, ``wanted(boe_id, article)``: by id forms, then by title, then its base article.

    The candidate ids of a distinct (law, article) are exploded with their priority and equi-joined
    to ``blocks(boe_id, pos, block_id, block_title)``; titles are matched by the number they hold.
    """
    asked = wanted.select("boe_id", "article").distinct()
    number = legal.normalize_article(F.col("article"))
    base = F.substring_index(number, ".", 1)
    ids = [
        F.concat(F.lit("a"), base),
        legal.article_word_id(base.try_cast("int")),
        F.concat(F.lit("art"), base),
        F.concat(F.lit("a"), base, F.lit("bis")),
        F.concat(F.lit("art"), base, F.lit("bis")),
        F.concat(F.lit("a"), number),
    ]
    candidates = [F.struct(F.lit(i).alias("priority"), F.concat(F.lit("id:"), c).alias("key")) for i, c in enumerate(ids)]
    n = len(ids)
    candidates += [
        F.struct(F.lit(n).alias("priority"), F.concat(F.lit("no:"), number).alias("key")),
        F.struct(F.lit(n + 1).alias("priority"), F.concat(F.lit("no:"), base).alias("key")),
    ]
    exploded = asked.select("boe_id", "article", F.inline(F.array(*candidates))).where(F.col("key").isNotNull())
    title_no = first_group(F.col("block_title"), TITLE_ARTICLE)
    block_keys = blocks.select(
        "boe_id", "pos", "block_id", "block_title",
        F.explode(F.array_compact(F.array(
            F.concat(F.lit("id:"), F.col("block_id")),
            F.concat(F.lit("no:"), title_no),
        ))).alias("key"),
    )
    # one block per key: copies of a key would only lose to the first one
    first = block_keys.groupBy("boe_id", "key").agg(F.min_by(F.struct("pos", "block_id", "block_title"), "pos").alias("block"))
    hits = (
        exploded.join(first, ["boe_id", "key"])
        .groupBy("boe_id", "article")
        .agg(F.min_by(F.struct("priority", "block"), F.struct("priority", "block.pos")).alias("__hit"))
    )
    return asked.join(hits, ["boe_id", "article"], "left").select(
        "boe_id",
        "article",
        F.col("__hit.block.block_id").alias("block_id"),
        F.col("__hit.block.block_title").alias("block_title"),
        F.col("__hit.priority").alias("priority"),
        F.when(F.col("__hit").isNotNull(), legal.registry_url(F.col("boe_id"), number)).alias("url"),
    )


def enrich_eu(mentions: DataFrame, eu_acts: DataFrame) -> DataFrame:
    """EU mentions with CELEX, link, and title when the act is known; unknown acts keep their CELEX."""
    keyed = mentions.withColumn("celex", legal.derive_celex(F.col("text")))
    acts = eu_acts.select(F.col("celex").alias("__c"), F.col("title").alias("eu_title"))
    known = acts.where(F.col("__c").isNotNull()).withColumn("__there", F.lit(True))
    joined = left_join_hot(keyed.where(F.col("celex").isNotNull()), known, {"celex": "__c"}, mentions.columns)
    return joined.select(
        *keyed.columns,
        legal.eu_url(F.col("celex"), F.lit("ES")).alias("eu_url"),
        F.col("__there").isNotNull().alias("act_exists"),
        "eu_title",
    )


def one_each(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key, the smallest values in the order given; rows with a null key go."""
    full = table.dropna(subset=keys)
    return full.groupBy(*keys).agg(F.min(F.struct(*values)).alias("__v")).select(*keys, "__v.*")


def law_article_answers(asked: DataFrame, articles: DataFrame) -> DataFrame:
    """Title and text of distinct ``asked(boe_id, article)``: the article itself, its base article, or the base
    article's id in words; ``found_as`` says which.

    ``articles(boe_id, number, article_title, article_text)``; the candidates of each pair meet it in one join.
    """
    number = F.regexp_replace(legal.normalize_article(F.col("article")), r"^0+(?=\d)", "")
    base = F.substring_index(number, ".", 1)
    steps = [("exact", number), ("base", base), ("word", legal.article_word_id(base.try_cast("int")))]
    structs = [F.struct(F.lit(i).alias("priority"), F.lit(name).alias("found_as"), key.alias("number")) for i, (name, key) in enumerate(steps)]
    keys = asked.dropna().distinct().select("boe_id", "article", F.inline(F.array(*structs))).where(F.col("number").isNotNull())
    known = one_each(articles, ["boe_id", "number"], ["article_title", "article_text"])
    best = F.min_by(F.struct("article_title", "article_text", "found_as"), "priority")
    return keys.join(known, ["boe_id", "number"]).groupBy("boe_id", "article").agg(best.alias("__b")).select("boe_id", "article", "__b.*")


def eu_article_answers(asked: DataFrame, eu_articles: DataFrame) -> DataFrame:
    """Titles and texts of distinct ``asked(celex, article)``, where an article may be a list like ``22 y 25``.

    ``eu_articles(celex, number, title, text)``. Found articles keep the order of the list; lists are as long as
    their mention, so they are put together per mention text.
    """
    listed = F.col("article").contains(" y ") | F.col("article").contains(",")
    numbers = F.when(listed, F.regexp_extract_all("article", F.lit(r"(\d+)"))).otherwise(F.array(F.trim(F.regexp_replace("article", FOLD + "art_", ""))))
    each = asked.dropna().distinct().select("celex", "article", F.posexplode(numbers).alias("at", "number"))
    known = one_each(eu_articles, ["celex", "number"], ["title", "text"])
    found = each.join(known, ["celex", "number"]).groupBy("celex", "article").agg(
        F.sort_array(F.collect_list(F.struct("at", "number", "title", "text"))).alias("__f")
    )
    title = F.transform("__f", lambda x: F.concat(F.lit("Art. "), x["number"], F.lit(": "), F.coalesce(x["title"], F.lit(""))))
    body = F.transform("__f", lambda x: F.coalesce(x["text"], F.lit("")))
    return found.select(
        "celex", "article", F.array_join(title, " | ").alias("eu_article_title"), F.array_join(body, "\n\n---\n\n").alias("eu_article_text")
    )


def enrich_mentions(
    mentions: DataFrame, laws: DataFrame, articles: DataFrame, eu_acts: DataFrame, eu_articles: DataFrame | None = None
) -> DataFrame:
    """Exportable mentions with expanded name, law title, article title and text, and EU data.

    ``laws(boe_id, law_title)``, ``articles(boe_id, number, article_title, article_text)``, ``eu_acts(celex, title)``,
    ``eu_articles(celex, number, title, text)``. A mention without an article but with inferred ``articles`` gets its
    first one as an example. Side tables may repeat keys; one row of each is used, so mentions never multiply. Each
    distinct law, article or act is looked up once, and answers are joined back with hot keys dealt out.
    """
    kept = mentions.where(legal.is_exportable(F.col("boe_id"), F.col("text")))
    named = dims.lookup(kept, dims.LAW_ACRONYMS, F.col("law"), "law_expanded")
    example = F.get("articles", F.lit(0)) if "articles" in mentions.columns else F.lit(None).cast("string")
    example = F.when(F.col("article").isNull(), example)
    keyed = named.withColumn("celex", legal.derive_celex(F.col("text"))).withColumn("example_article", example)
    keyed = keyed.withColumn("__article", F.coalesce("article", "example_article"))

    out = left_join_hot(keyed, _keys(one_each(laws, ["boe_id"], ["law_title"]), boe_id="__id"), {"boe_id": "__id"}, "mention_id")
    asked = keyed.select("boe_id", F.col("__article").alias("article"))
    answers = _keys(law_article_answers(asked, articles), boe_id="__id", article="__no")
    out = left_join_hot(out, answers, {"boe_id": "__id", "__article": "__no"}, "mention_id").drop("__article")
    acts = one_each(eu_acts, ["celex"], ["title"]).withColumnRenamed("title", "eu_title")
    out = left_join_hot(out, _keys(acts, celex="__c"), {"celex": "__c"}, "mention_id")
    if eu_articles is not None:
        answers = _keys(eu_article_answers(keyed.select("celex", "article"), eu_articles), celex="__c", article="__no")
        out = left_join_hot(out, answers, {"celex": "__c", "article": "__no"}, "mention_id")
    return out.withColumn("eu_url", legal.eu_url(F.col("celex"), F.lit("ES"))).withColumn("boe_url", legal.registry_url(F.col("boe_id")))


def _keys(table: DataFrame, **names: str) -> DataFrame:
    return table.withColumnsRenamed(names)


def eu_article_summary(wanted: DataFrame, eu_articles: DataFrame) -> DataFrame:
    """Per act: how many of the wanted articles were found. ``wanted(celex, article)``."""
    known = eu_articles.select(F.col("celex").alias("__c"), F.col("article").alias("__a")).distinct()
    asked = wanted.withColumn("__n", F.trim(F.regexp_replace("article", FOLD + "art_", "")))
    joined = asked.join(known, (F.col("celex") == F.col("__c")) & (F.col("__n") == F.col("__a")), "left")
    return joined.groupBy("celex").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("__a").alias("ok"),
        (F.count(F.lit(1)) - F.count("__a")).alias("failed"),
    )
