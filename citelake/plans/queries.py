"""One function per operator: the given tables in, a result table out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions import legal, markup, text
from citelake.operators import (
    audit, consensus, dedupe, extract, filters, infer, laws, locate, normalize, registry, report, requests, resolve, whole,
)
from citelake.plans import fixtures as fx
from citelake.session import checkpoint_dir, cut_lineage
from citelake.sources import cache, files, topics
from citelake.sources import registry as payloads
from citelake.streaming import admission, intake, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MENTION_WIDTH = 100_000_000_000_000  # one line number of a document
TEXT_WIDTH = 50_000  # characters
BLOCK_WIDTH = 1_000  # index blocks


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- sources and sinks ---------------------------------------------------------

@query
def topic_json_scan(spark, d):
    raw = fx.read(spark, d, "pages").select("page_id", topics.topic_json(F.col("html")).alias("json"))
    return raw.select("page_id", topics.topic_html(F.col("json")).alias("html"))


@query
def topic_json_rescue(spark, d):
    raw = fx.project(fx.read(spark, d, "pages"), fx.BROKEN_TOPICS)
    return topics.rescue_topics(raw).select("page_id", "rescued", F.md5("html").alias("html_md5"), F.length("html").alias("n"))


@query
def text_decode_fallback(spark, d):
    raw = fx.read(spark, d, "documents").select(
        "doc_id",
        F.when(
            F.col("text").rlike(r"[^\x00-\xff]"), F.encode("text", "UTF-8")
        ).otherwise(F.encode("text", "ISO-8859-1")).alias("content"),
    )
    decoded = topics.decode_text(F.col("content"))
    return raw.select("doc_id", F.length(decoded).alias("n"), F.md5(decoded).alias("text_md5"))


@query
def file_manifest(spark, d):
    return files.manifest(spark, d, ("parquet",), magic={"parquet": b"PAR1"}).select(
        "name", "size", "extension", "too_large", "content_fits"
    )


@query
def text_to_topic_html(spark, d):
    docs = fx.project(fx.read(spark, d, "documents"), fx.PARAGRAPH_DOCUMENTS)
    return docs.select("doc_id", topics.text_to_html(F.col("source"), F.col("text")).alias("html"))


@query
def alias_dictionary(spark, d):
    return normalize.alias_dictionary(fx.alias_rows(spark, d))


@query
def alias_laws(spark, d):
    return normalize.alias_laws(fx.alias_rows(spark, d))


@query
def law_index_scan(spark, d):
    xml = fx.project(fx.read(spark, d, "part"), fx.INDEX_XML)
    return payloads.parse_law_index(xml).select("p_partkey", "block_no", "id", "titulo")


@query
def registry_search_pick(spark, d):
    xml = fx.project(fx.read(spark, d, "part"), fx.SEARCH_XML)
    return xml.select("p_partkey", "kind", payloads.pick_registry_id(F.col("xml"), F.col("kind")).alias("boe_id"))


@query
def article_block_parse(spark, d):
    xml = fx.project(fx.read(spark, d, "part"), fx.BLOCK_XML)
    parsed = xml.select("p_partkey", payloads.parse_article_block(F.col("xml")).alias("b"))
    return parsed.select("p_partkey", F.col("b.title").alias("title"), F.col("b.body").alias("body"))


@query
def eu_metadata_parse(spark, d):
    raw = fx.project(fx.read(spark, d, "part"), fx.EU_META_JSON)
    parsed = raw.select("p_partkey", payloads.parse_eu_metadata(F.col("json")).alias("m"))
    return parsed.select(
        "p_partkey", F.col("m.exists").alias("act_exists"), F.col("m.work_uri").alias("work_uri"),
        F.col("m.title").alias("title"), F.col("m.date").alias("date"), F.col("m.type").alias("type"),
    )


@query
def cache_upsert_latest(spark, d):
    return cache.upsert_latest(fx.lookup_cache(spark, d))


@query
def cache_ttl_filter(spark, d):
    rows = cache.upsert_latest(fx.lookup_cache(spark, d))
    return cache.within_ttl(rows, F.expr(f"TIMESTAMP_NTZ '{fx.AS_OF}'"), 2)


def _new_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def cache_upsert_stored(spark, d):
    rows = fx.lookup_cache(spark, d)
    table = cache.stored_cache(spark, _new_folder(spark, "cache"), rows.schema.simpleString()[7:-1].replace(":", " "), 8)
    for part in (2, 0, 1, 2):  # a part that arrives again changes nothing
        table.merge(rows.where(F.pmod("event_id", F.lit(3)) == part))
    return table.read()


@query
def stream_cache_upsert(spark, d):
    events = intake.table_as_it_comes(spark, f"{d}/events.parquet", fx.read(spark, d, "events").schema)
    lookups = fx.project(events, fx.LOOKUP_CACHE)
    base = _new_folder(spark, "cache")
    table = cache.stored_cache(spark, f"{base}/rows", lookups.schema.simpleString()[7:-1].replace(":", " "), 8)
    cache.upsert_stream(lookups, table, f"{base}/state")
    return table.read()


@query
def request_key(spark, d):
    docs = fx.cited_documents(spark, d)
    return docs.select("doc_id", text.request_key("extract", F.col("text")).alias("request_key"))


@query
def report_markdown(spark, d):
    verified = filters.exportable(fx.mention_facts(spark, d))
    return report.report_markdown(verified, "01/01/2024 00:00", MENTION_WIDTH)


@query
def report_markdown_inferred(spark, d):
    inferred = report.first_articles(_validated_ranges(spark, d))
    verified = filters.exportable(fx.mention_facts(spark, d)).join(inferred.select("doc_id").distinct(), "doc_id", "left_semi")
    return report.report_markdown(verified, "01/01/2024 00:00", MENTION_WIDTH, inferred)


@query
def report_text(spark, d):
    verified = filters.exportable(fx.mention_facts(spark, d))
    return report.report_text(verified, "01/01/2024 00:00", MENTION_WIDTH)


@query
def report_markdown_enriched(spark, d):
    return report.report_markdown(cut_lineage(_enriched(spark, d)), "01/01/2024 00:00", MENTION_WIDTH)


@query
def report_text_inferred(spark, d):
    inferred = report.first_articles(_validated_ranges(spark, d))
    return report.report_text(cut_lineage(_enriched(spark, d)), "01/01/2024 00:00", MENTION_WIDTH, inferred)


@query
def report_json(spark, d):
    return report.report_json(filters.project_result(fx.mention_facts(spark, d)))


@query
def sanitize_name(spark, d):
    pages = fx.read(spark, d, "pages")
    return pages.select("page_id", text.sanitize_name(markup.main_title(F.col("html"))).alias("name"))


# -- text preparation -------------------------------------------------------------

@query
def html_clean_text(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_OUTLINE)
    return pages.select("page_id", markup.clean_text(F.col("html")).alias("text"))


@query
def html_doc_stats(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_OUTLINE)
    cleaned = pages.select("page_id", "html", markup.clean_text(F.col("html")).alias("text"))
    return cleaned.select(
        "page_id",
        F.length("text").alias("total_chars"),
        F.size(markup.lines_of(F.col("text"))).alias("total_lines"),
        (markup.count_tag(F.col("html"), "h1") > 0).alias("has_h1"),
        (markup.count_tag(F.col("html"), "h2") > 0).alias("has_h2"),
        markup.count_tag(F.col("html"), "p").alias("n_paragraphs"),
    )


@query
def html_outline(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_OUTLINE)
    sections = pages.select(
        "page_id", markup.main_title(F.col("html")).alias("main_title"), F.explode_outer(markup.outline(F.col("html"))).alias("s")
    )
    return sections.select(
        "page_id", "main_title", F.col("s.num").alias("num"), F.col("s.title").alias("title"),
        F.array_join("s.subs", " | ").alias("subs"),
    )


@query
def strip_tags(spark, d):
    return fx.read(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query
def truncate_text(spark, d):
    cut = text.truncate_text(F.col("text"), 50_000, "\n\n[... texto truncado ...]")
    return fx.cited_documents(spark, d).select(
        "doc_id", F.length(cut).alias("n"), F.md5(cut).alias("text_md5"), (F.length("text") > 50_000).alias("truncated")
    )


@query
def chunk_documents(spark, d):
    docs = fx.cited_documents(spark, d)
    return docs.select("doc_id", F.inline(text.chunk_text(F.col("text"), 2000, 200))).select(
        "doc_id", "chunk_no", "start", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5")
    )


@query
def clean_reference(spark, d):
    rows = fx.project(fx.read(spark, d, "lineitem"), fx.RAW_REFERENCES)
    return rows.select("mention_id", legal.clean_reference(F.col("raw")).alias("ref"))


# -- extraction -------------------------------------------------------------------------

@query
def extract_profile_a(spark, d):
    return extract.extract(fx.cited_documents(spark, d), ("A",))


@query
def extract_profile_b(spark, d):
    return extract.extract(fx.cited_documents(spark, d), ("B",))


@query
def extract_profile_c(spark, d):
    return extract.extract(fx.cited_documents(spark, d), ("C",))


@query
def extract_all_profiles(spark, d):
    return extract.extract(fx.cited_documents(spark, d))


@query
def extract_article_law(spark, d):
    return extract.extract_article_law(fx.cited_documents(spark, d))


@query
def explode_multi_article(spark, d):
    rows = fx.project(fx.read(spark, d, "lineitem"), fx.ARTICLE_LISTS)
    return extract.explode_articles(rows).select("mention_id", "article", "article_idx", "article_one")


@query
def mention_context(spark, d):
    return extract.with_context(fx.cited_documents(spark, d)).select("doc_id", "mention_id", "text", "place", "context")


@query
def drop_caselaw(spark, d):
    rows = fx.project(fx.read(spark, d, "lineitem"), fx.NOISY_MENTIONS)
    return extract.drop_noise(rows)


@query
def flag_contextual(spark, d):
    return fx.cited_documents(spark, d).select("doc_id", legal.is_contextual(F.col("text")).alias("contextual"))


@query
def flag_eu(spark, d):
    return fx.cited_documents(spark, d).select("doc_id", legal.is_eu(F.col("text")).alias("eu"))


@query
def model_requests(spark, d):
    open_mentions = fx.mention_facts(spark, d).where(F.coalesce("confidence", F.lit(100)) < 100)
    answered_docs = fx.read(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("doc_id"))
    # a document's batches are its own, so those of the answered documents are among the ones asked
    asked = cut_lineage(requests.batch_requests(open_mentions, 10, MENTION_WIDTH))
    answered = asked.join(answered_docs, "doc_id", "left_semi")
    return asked.join(answered.select("request_key").distinct(), "request_key", "left_anti").select(
        "doc_id", "batch_id", "mentions", "body", "request_key"
    )


@query
def extraction_requests(spark, d):
    docs = fx.cited_documents(spark, d)
    previous = extract.extract(docs, ("B",))
    return requests.extraction_requests(docs, previous, requests.acronym_hints(), 50_000, 500)


@query
def model_responses_parse(spark, d):
    return requests.parse_responses(fx.project(fx.read(spark, d, "orders"), fx.RESPONSES))


@query
def locate_mentions(spark, d):
    docs = fx.read(spark, d, "documents")
    answers = requests.parse_responses(fx.project(docs, fx.DOCUMENT_RESPONSES))
    return locate.locate(fx.project(docs, fx.ANSWERED_DOCUMENTS), answers, 40)


@query
def request_usage(spark, d):
    calls = fx.project(fx.read(spark, d, "events"), fx.MODEL_CALLS)
    return requests.usage(calls)


# -- filters ---------------------------------------------------------------------------------

@query
def threshold_default100(spark, d):
    return filters.threshold(fx.mention_facts(spark, d), 70, 100)


@query
def threshold_default0(spark, d):
    return filters.threshold_counts(fx.mention_facts(spark, d), 70, 0)


@query
def exportable(spark, d):
    docs = extract.extract_eu(fx.cited_documents(spark, d))
    return filters.exportable(docs.withColumn("boe_id", F.lit(None).cast("string"))).drop("boe_id").unionByName(
        filters.exportable(fx.mention_facts(spark, d)).select("doc_id", "start", "text")
    )


@query
def search_mentions(spark, d):
    return filters.search(fx.mention_facts(spark, d), "Ley 1").select("doc_id", "mention_id", "text", "law", "article")


@query
def distinct_kinds(spark, d):
    return filters.distinct_kinds(fx.mention_facts(spark, d))


@query
def sort_mentions(spark, d):
    return filters.sort_mentions(fx.mention_facts(spark, d)).select("mention_id", "confidence", "kind", "law")


@query
def topk_per_doc(spark, d):
    return filters.top_k(fx.mention_facts(spark, d), 3).select("doc_id", "mention_id", "rank", "confidence")


@query
def project_result(spark, d):
    return filters.project_result(fx.mention_facts(spark, d))


@query
def split_incomplete(spark, d):
    flagged = filters.split_incomplete(fx.mention_facts(spark, d))
    return flagged.groupBy("doc_id", "incomplete").agg(F.count(F.lit(1)).alias("mentions"))


# -- de-duplication and convergence -----------------------------------------------------------------

@query
def dedupe_exact(spark, d):
    return dedupe.dedupe_exact(fx.mention_facts(spark, d))


def _rounds(spark, d, agent):
    facts = fx.mention_facts(spark, d)
    return facts.where((F.col("agent") == agent) & (F.col("round") > 1)), facts.where(F.col("round") == 1)


@query
def dedupe_prev_a(spark, d):
    return dedupe.new_texts(*_rounds(spark, d, "A"))


@query
def dedupe_prev_b(spark, d):
    return dedupe.new_texts_or_laws(*_rounds(spark, d, "B"))


@query
def dedupe_prev_c(spark, d):
    return dedupe.new_texts_squeezed(*_rounds(spark, d, "C"))


@query
def dedupe_text_or_law(spark, d):
    return dedupe.dedupe_text_or_law(fx.mention_facts(spark, d))


@query
def dedupe_canonical(spark, d):
    return dedupe.dedupe_canonical(fx.mention_facts(spark, d))


@query
def attribute_agent(spark, d):
    return dedupe.attribute_agent(fx.mention_facts(spark, d))


def _article_mentions(spark, d):
    """Full-form mentions with the identity of their law: registry id, CELEX, or the law itself."""
    found = extract.extract_article_law(fx.cited_documents(spark, d)).withColumn("agent", F.lit("C"))
    found = found.unionByName(
        extract.extract(fx.cited_documents(spark, d), ("A", "C")).select(
            "doc_id", "start", "text", "article", F.coalesce(legal.law_form(F.col("text"))[0], F.col("text")).alias("law"), "agent"
        )
    )
    identified = registry.registry_ids(found.withColumn("ref", F.col("law")).withColumn("title", F.lit(None).cast("string")))
    eu = dims.lookup(identified, dims.EU_CELEX, F.col("law"), "celex")
    return eu.withColumn("identity", F.coalesce("boe_id", "celex", "law")).withColumn(
        "mention_id", extract.mention_id(F.col("doc_id"), F.col("agent"), F.col("start"), F.col("text"))
    )


@query
def dedupe_semantic(spark, d):
    return dedupe.dedupe_semantic(_article_mentions(spark, d)).select("doc_id", "key", "text", "agent", "start")


@query
def near_dup_names(spark, d):
    return dedupe.near_names(fx.project(fx.read(spark, d, "part"), fx.NAME_SPELLINGS), "law_name")


@query
def converge_mentions(spark, d):
    found = extract.extract(fx.cited_documents(spark, d)).select(
        "doc_id",
        text.normal_text(F.col("text")).alias("key"),
        dedupe.agent_rank(F.col("agent")).alias("rung"),
    )

    def expand(newest: DataFrame) -> DataFrame:
        edges = dims.mapping_table(newest.sparkSession, fx.ALIAS_EDGES, "key", "other")
        return newest.join(F.broadcast(edges), "key").select("doc_id", F.col("other").alias("key"))

    return dedupe.converge(found, 3, expand)


@query
def round_history(spark, d):
    return dedupe.round_history(fx.mention_facts(spark, d))


@query
def convergence_stats(spark, d):
    return dedupe.convergence_stats(fx.mention_facts(spark, d))


# -- resolution ----------------------------------------------------------------------------------------

def _law_mentions(spark, d):
    found = extract.extract(fx.cited_documents(spark, d), ("C",))
    return found.withColumn("law", F.coalesce(legal.law_form(F.col("text"))[0], F.col("text")))


@query
def principal_law(spark, d):
    return resolve.principal_law(_law_mentions(spark, d))


@query
def resolve_second_pass(spark, d):
    facts = fx.mention_facts(spark, d)
    return resolve.second_pass(facts, resolve.principal_law(facts, 50))


@query
def resolve_anaphora(spark, d):
    docs = fx.cited_documents(spark, d)
    pointers = extract.extract_anaphora(docs).select("doc_id", "start", "text", F.lit(None).cast("string").alias("law"))
    named = _law_mentions(spark, d).select("doc_id", "start", "text", "law")
    resolved = resolve.resolve_pointers(named.unionByName(pointers), TEXT_WIDTH)
    return resolved.where(F.col("law").isNull()).select("doc_id", "start", "text", "resolved_law")


@query
def resolve_prev_article(spark, d):
    return resolve.previous_article(fx.mention_facts(spark, d), MENTION_WIDTH).select(
        "doc_id", "mention_id", "article", "previous_article"
    )


def _resolved(spark, d):
    """Mentions with the answers to their batches; the numbered mentions are written once and read for both."""
    facts = fx.mention_facts(spark, d).select("doc_id", "mention_id", "agent", "start", "law", "confidence")
    batched = cut_lineage(resolve.batches(facts, 10, MENTION_WIDTH).drop("agent", "start"))
    return resolve.apply_resolutions(batched, fx.project(batched, fx.ANSWERS))


@query
def apply_resolutions(spark, d):
    return _resolved(spark, d).drop("before")


@query
def resolution_metrics(spark, d):
    return _resolved(spark, d).agg(*resolve.resolution_metrics(F.col("before"), F.col("confidence"), F.col("resolved")))


@query
def resolve_titles(spark, d):
    found = extract.extract(fx.cited_documents(spark, d), ("B", "C"))
    keyed = found.withColumn("law", F.when(F.col("kind") == "sigla", F.col("text")).otherwise(F.col("law")))
    return resolve.resolve_titles(keyed.where(F.col("kind") != "articulo")).select(
        "doc_id", "mention_id", "text", "title", "title_resolved", "title_confidence"
    )


# -- normalisation ----------------------------------------------------------------------------------------

@query
def is_acronym(spark, d):
    return fx.mention_facts(spark, d).select(
        "mention_id", "kind", "text", legal.is_acronym(F.lit("ley"), F.col("text")).alias("by_text"),
        legal.is_acronym(F.col("kind"), F.col("text")).alias("acronym"),
    )


def _acronym_mentions(spark, d):
    part = fx.read(spark, d, "part")
    lines = fx.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return fx.project(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), fx.ACRONYM_MENTIONS)


@query
def expand_acronyms(spark, d):
    dictionary = normalize.alias_dictionary(fx.alias_rows(spark, d))
    return normalize.expand_acronyms(_acronym_mentions(spark, d), dictionary)


@query
def expand_ambiguous(spark, d):
    dictionary = normalize.alias_dictionary(fx.alias_rows(spark, d)).where(F.col("meanings") > 1)
    out = normalize.expand_acronyms(_acronym_mentions(spark, d), dictionary).where("ambiguous")
    return out.groupBy("acronym", "meaning").agg(F.count(F.lit(1)).alias("mentions"))


@query
def normalize_law(spark, d):
    found = extract.extract(fx.cited_documents(spark, d))
    return normalize.normalize_law(found).select("mention_id", "text", "law", "law_norm", "law_type")


@query
def normalize_eu(spark, d):
    found = extract.extract_eu(fx.cited_documents(spark, d))
    return normalize.normalize_eu(found)


@query
def derive_celex(spark, d):
    rows = fx.project(fx.read(spark, d, "part"), fx.EU_REFERENCES)
    return rows.select("p_partkey", "text", legal.derive_celex(F.col("text")).alias("celex"))


@query
def derive_celex_raw(spark, d):
    rows = fx.project(fx.read(spark, d, "part"), fx.EU_REFERENCES)
    return rows.select("p_partkey", "text", legal.derive_celex_raw(F.col("text")).alias("celex"))


@query
def celex_lookup(spark, d):
    rows = fx.project(fx.read(spark, d, "part"), fx.LAW_NAMES)
    return dims.lookup(rows, dims.EU_CELEX, F.col("name"), "celex").select("p_partkey", "name", "celex")


@query
def eu_urls(spark, d):
    acts = fx.project(fx.read(spark, d, "part"), fx.EU_REFERENCES).select(legal.derive_celex(F.col("text")).alias("celex"))
    return normalize.eu_urls(acts.where(F.col("celex").isNotNull()).distinct())


@query
def process_law_name(spark, d):
    rows = fx.project(fx.read(spark, d, "part"), fx.LAW_NAMES)
    return normalize.process_names(rows, "name")


@query
def categorize(spark, d):
    return normalize.categorize(fx.mention_facts(spark, d)).select("mention_id", "kind", "category", "has_id", "has_article")


@query
def normalize_article(spark, d):
    return fx.law_mentions(spark, d).select(
        "mention_id", "article", legal.normalize_article(F.col("article")).alias("number")
    )


@query
def article_word_dim(spark, d):
    numbers = fx.read(spark, d, "part").select((F.col("p_partkey") % 1000).cast("int").alias("n")).distinct()
    return numbers.select("n", legal.article_word_id(F.col("n")).alias("block_id"))


@query
def canonical_key(spark, d):
    return dedupe.with_key(fx.mention_facts(spark, d)).select("mention_id", "key")


@query
def acronym_to_law(spark, d):
    alias_table = normalize.alias_laws(fx.alias_rows(spark, d))
    mentions = fx.project(_acronym_mentions(spark, d), {"mention_id": "mention_id", "text": "dotted"})
    cited = extract.extract(fx.cited_documents(spark, d), ("B",)).where(F.col("kind") == "sigla").select("mention_id", "text")
    return normalize.acronym_to_law(mentions.unionByName(cited), alias_table)


@query
def normalize_mentions(spark, d):
    parts = cut_lineage(extract.stretches(fx.cited_documents(spark, d)))
    found, eu = extract.extract(parts), extract.extract_eu(parts)
    both = found.select("doc_id", "agent", "kind", "text", "law", "start").unionByName(
        eu.select("doc_id", F.lit("C").alias("agent"), F.lit("reglamento").alias("kind"), "text", F.lit(None).cast("string").alias("law"), "start")
    )
    return normalize.normalize_mentions(both)


# -- registry and validation ----------------------------------------------------------------------------------

@query
def extract_law_info(spark, d):
    found = normalize.normalize_law(extract.extract(fx.cited_documents(spark, d)))
    return registry.extract_law_info(found).select("mention_id", "ref", "ref_year")


def _references(spark, d):
    found = normalize.normalize_law(extract.extract(fx.cited_documents(spark, d)))
    info = registry.extract_law_info(found).where(F.col("ref").isNotNull())
    titled = dims.lookup(info, dims.law_titles(), F.upper("ref"), "title")
    return titled.select("mention_id", "ref", "title")


@query
def registry_lookup(spark, d):
    return registry.registry_ids(_references(spark, d)).select("mention_id", "ref", "boe_id", "found_by")


@query
def bulk_lookup(spark, d):
    rows = fx.mention_facts(spark, d).select("mention_id", F.col("law").alias("ref"), F.lit(None).cast("string").alias("title"))
    return registry.bulk_lookup(rows.where(F.col("ref").isNotNull())).select("mention_id", "ref", "boe_id", "found_by")


@query
def registry_year_range(spark, d):
    entries = fx.project(fx.read(spark, d, "part"), fx.YEAR_REGISTRY)
    refs = fx.project(fx.read(spark, d, "lineitem"), fx.YEAR_REFERENCES)
    return registry.registry_year_range(refs, entries)


@query
def registry_cascade(spark, d):
    entries = fx.project(fx.read(spark, d, "part"), fx.YEAR_REGISTRY)
    return registry.registry_cascade(fx.project(fx.read(spark, d, "lineitem"), fx.CASCADE_REFERENCES), entries, 2024)


@query
def article_format_valid(spark, d):
    return fx.law_mentions(spark, d).select(
        "mention_id", "article", legal.article_format_valid(F.col("article")).alias("valid")
    )


def _law_articles(spark, d):
    return laws.articles_flat(fx.law_blocks(spark, d), BLOCK_WIDTH).select("boe_id", "number")


@query
def validate_articles(spark, d):
    return registry.check_articles(fx.law_mentions(spark, d), _law_articles(spark, d))


@query
def hallucinated_articles(spark, d):
    checked = registry.check_articles(fx.law_mentions(spark, d), _law_articles(spark, d))
    return registry.hallucinated(checked).select("mention_id", "boe_id", "article")


@query
def validate_mentions(spark, d):
    facts = fx.mention_facts(spark, d).select("doc_id", "mention_id", "text", "law", "article")
    articles = fx.project(fx.read(spark, d, "part"), fx.REGISTRY_ARTICLES)
    return registry.validate_mentions(normalize.normalize_law(facts), articles).select(
        "doc_id", "mention_id", "ref", "boe_id", "article", "article_exists", "article_valid", "validated", "reason", "boe_url"
    )


@query
def validation_stats(spark, d):
    return registry.validation_stats(fx.mention_facts(spark, d), ["agent"])


@query
def article_text_lookup(spark, d):
    return registry.article_texts(fx.law_mentions(spark, d).where(F.col("article").isNotNull()), fx.law_blocks(spark, d))


@query
def enrich_eu(spark, d):
    acts = fx.project(fx.read(spark, d, "pages"), fx.EU_ACTS).distinct()
    return registry.enrich_eu(extract.extract_eu(fx.cited_documents(spark, d)), acts)


def _enriched(spark, d):
    inferred = F.when(F.col("inferred").isNotNull(), F.split("inferred", ","))
    facts = fx.project(fx.read(spark, d, "lineitem"), fx.ENRICH_MENTIONS).withColumn("articles", inferred).drop("inferred")
    law_titles = fx.project(fx.read(spark, d, "nation"), fx.LAW_TITLES)
    articles = fx.project(fx.read(spark, d, "part"), fx.ENRICH_ARTICLES)
    pages = fx.read(spark, d, "pages")
    return registry.enrich_mentions(facts, law_titles, articles, fx.project(pages, fx.EU_ACTS), fx.project(pages, fx.ENRICH_EU_ARTICLES))


@query
def enrich_mentions(spark, d):
    return _enriched(spark, d).drop("articles", "kind", "start")


@query
def eu_article_batch(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_EU)
    found = pages.select(F.expr(fx.PAGE_CELEX.format(k="page_id")).alias("celex"), F.explode(markup.eu_articles(F.col("html"))).alias("a")).select(
        "celex", F.col("a.article").alias("article")
    )
    wanted = fx.project(fx.read(spark, d, "lineitem"), fx.EU_WANTED)
    return registry.eu_article_summary(wanted, found)


# -- law corpus --------------------------------------------------------------------------------------------------

@query
def classify_blocks(spark, d):
    blocks = fx.law_blocks(spark, d)
    return blocks.select("boe_id", "pos", "block_id", laws.block_type(F.col("block_id")).alias("block_type"))


@query
def law_hierarchy(spark, d):
    return laws.hierarchy(fx.law_blocks(spark, d), BLOCK_WIDTH)


@query
def law_articles_flat(spark, d):
    return laws.articles_flat(fx.law_blocks(spark, d), BLOCK_WIDTH)


@query
def concept_to_articles(spark, d):
    return laws.concept_to_articles(laws.articles_flat(fx.law_blocks(spark, d), BLOCK_WIDTH), fx.CONCEPTS)


@query
def law_index_stats(spark, d):
    return laws.index_stats(laws.articles_flat(fx.law_blocks(spark, d), BLOCK_WIDTH))


def _page_articles(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_LAW)
    return pages.select("page_id", F.explode(markup.articles(F.col("html"))).alias("a")).select("page_id", "a.*")


@query
def html_articles(spark, d):
    return _page_articles(spark, d).select("page_id", "number", "body")


@query
def html_articles_last(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_LAW)
    return pages.select("page_id", F.explode(markup.articles(F.col("html"), keep="last")).alias("a")).select(
        "page_id", "a.number", "a.body"
    )


@query
def article_titles(spark, d):
    return _page_articles(spark, d).select("page_id", "number", "title")


@query
def article_paragraphs(spark, d):
    return _page_articles(spark, d).select("page_id", "number", F.posexplode("items").alias("n", "item"))


@query
def article_prefix_lookup(spark, d):
    wanted = fx.read(spark, d, "pages").select("page_id", (F.col("page_id") % 40 + 2).cast("string").alias("wanted"))
    joined = _page_articles(spark, d).join(wanted, "page_id")
    fits = (F.col("number") == F.col("wanted")) | F.col("number").startswith(F.concat(F.col("wanted"), F.lit(".")))
    return joined.where(fits).groupBy("page_id", "wanted").agg(
        F.min_by("number", "pos").alias("number"), F.min_by("body", "pos").alias("body")
    )


@query
def search_articles(spark, d):
    hits = F.col("body").rlike("(?iu)" + r"objeto\s+de|ÁMBITO")
    return _page_articles(spark, d).where(hits).select("page_id", "number", "body")


@query
def article_stats(spark, d):
    return _page_articles(spark, d).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count("title").alias("with_title"),
        F.count_if(F.size("items") > 0).alias("with_paragraphs"),
        text.rounded(F.avg(F.length("body")), 6).alias("mean_length"),
    )


@query
def law_metadata(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_LAW)
    return pages.select("page_id", markup.law_metadata(F.col("html")).alias("m")).select("page_id", "m.*")


@query
def eu_articles(spark, d):
    pages = fx.planted_pages(spark, d, fx.PLANTED_EU)
    rows = pages.select("page_id", F.explode(markup.eu_articles(F.col("html"))).alias("a"))
    return rows.select(
        "page_id", F.col("a.article").alias("article"), F.col("a.title").alias("title"), F.col("a.text").alias("text"),
        F.array_join("a.items", " | ").alias("items"), F.size("a.items").alias("n_items"), F.length("a.text").alias("n"),
    )


@query
def eu_act_title(spark, d):
    pages = fx.project(fx.read(spark, d, "pages"), fx.EU_TITLE_PAGES)
    return pages.select("page_id", markup.eu_title(F.col("html")).alias("title"))


# -- consensus ------------------------------------------------------------------------------------------------------

def _keyed(spark, d):
    return dedupe.with_key(fx.mention_facts(spark, d))


@query
def agent_keys(spark, d):
    return consensus.agent_keys(_keyed(spark, d))


@query
def consensus_levels(spark, d):
    return consensus.consensus(_keyed(spark, d))


QUERIES["consensus"] = QUERIES.pop("consensus_levels")


@query
def unique_by_agent(spark, d):
    return consensus.unique_by_agent(_keyed(spark, d))


@query
def agreement_metrics(spark, d):
    return consensus.agreement_metrics(_keyed(spark, d))


@query
def agents_union(spark, d):
    return consensus.agents_union(_keyed(spark, d))


@query
def agents_intersect(spark, d):
    return consensus.agents_intersect(_keyed(spark, d), "A", "B")


@query
def agents_except(spark, d):
    return consensus.agents_except(_keyed(spark, d), "A")


@query
def agreement_matrix(spark, d):
    return consensus.agreement_matrix(_keyed(spark, d))


@query
def consensus_report(spark, d):
    keyed = _keyed(spark, d)
    sizes = keyed.groupBy("doc_id", "agent").agg(F.count(F.lit(1)).alias("mentions"))
    return report.consensus_report(consensus.consensus(keyed), consensus.unique_by_agent(keyed), sizes)


# -- audit -------------------------------------------------------------------------------------------------------------

@query
def audit_confidence(spark, d):
    return audit.audit_confidence(fx.mention_facts(spark, d))


@query
def audit_validation(spark, d):
    return audit.audit_validation(fx.mention_facts(spark, d))


@query
def audit_coverage(spark, d):
    return audit.audit_coverage(fx.mention_facts(spark, d))


@query
def coverage_cube(spark, d):
    return audit.coverage_cube(fx.mention_facts(spark, d))


@query
def audit_problems(spark, d):
    facts = fx.mention_facts(spark, d)
    return audit.audit_problems(facts, _convergence(facts))


def _convergence(facts):
    """A document converged when its last round brought nothing new."""
    history = dedupe.round_history(facts)
    return history.groupBy("doc_id").agg(F.max_by("converged", "round").alias("converged"))


@query
def audit_suggestions(spark, d):
    return audit.audit_suggestions(fx.mention_facts(spark, d))


@query
def audit_grade(spark, d):
    return audit.audit_grade(fx.mention_facts(spark, d))


@query
def audit_report(spark, d):
    facts = fx.mention_facts(spark, d)
    return report.audit_report(audit.audit(facts), facts)


@query
def audit_review(spark, d):
    return audit.review(fx.mention_facts(spark, d), MENTION_WIDTH)


@query
def corpus_summary(spark, d):
    facts = fx.mention_facts(spark, d)
    levels = consensus.consensus(dedupe.with_key(facts))
    audited = audit.profile(facts).select("doc_id", "total", "validated", "rate", *audit.grade_columns())
    history = dedupe.round_history(facts).groupBy("doc_id").agg(
        F.max("round").alias("rounds"), F.max_by("converged", "round").alias("converged")
    )
    agreement = 100.0 * (F.col("total_consensus") + F.col("partial_consensus")) / F.col("distinct_keys")
    return audited.join(levels, "doc_id").join(history, "doc_id").select(
        "doc_id", "total", "validated", "rate", "rounds", "converged", "total_consensus", "partial_consensus",
        text.rounded(agreement, 6).alias("agreement"), "grade", "level",
    )


# -- inference --------------------------------------------------------------------------------------------------------------

@query
def detect_concepts(spark, d):
    cited = fx.project(fx.read(spark, d, "lineitem"), fx.CONCEPT_CITED).select("doc_id", "boe_id").distinct()
    return infer.detect_concepts(fx.concept_documents(spark, d), fx.CONCEPT_NAMES, cited, fx.concept_map(spark, d))


def _found_concepts(spark, d):
    return infer.detect_concepts(fx.concept_documents(spark, d), fx.CONCEPT_NAMES)


@query
def concept_ranges(spark, d):
    return infer.concept_ranges(_found_concepts(spark, d), infer.spread_ranges(fx.concept_map(spark, d)))


def _validated_ranges(spark, d):
    real = fx.project(fx.read(spark, d, "part"), fx.CONCEPT_ARTICLES)
    valid = infer.validate_ranges(infer.spread_ranges(fx.concept_map(spark, d)), real)
    return infer.concept_ranges(_found_concepts(spark, d), valid)


@query
def validate_ranges(spark, d):
    return _validated_ranges(spark, d)


@query
def inferred_new_only(spark, d):
    cited = fx.project(fx.read(spark, d, "lineitem"), fx.CONCEPT_CITED)
    return infer.new_only(_validated_ranges(spark, d), cited)


# -- streaming --------------------------------------------------------------------------------------------------------------------

@query
def stream_extract(spark, d):
    schema = fx.read(spark, d, "documents").schema
    docs = fx.project(intake.table_as_it_comes(spark, f"{d}/documents.parquet", schema), fx.CITED_DOCUMENTS)
    return intake.take_in(docs, intake.extract_stream, _new_folder(spark, "mentions"), 8)


@query
def rate_window_count(spark, d):
    return admission.rate_counts(fx.request_log(spark, d))


@query
def rate_admission(spark, d):
    return admission.admit(fx.request_log(spark, d))


@query
def job_windows(spark, d):
    return jobs.job_windows(fx.job_log(spark, d))


@query
def stream_job_windows(spark, d):
    schema = fx.read(spark, d, "events").schema
    events = intake.table_as_it_comes(spark, f"{d}/events.parquet", schema)
    log = fx.project(events, fx.JOB_LOG).withColumn("ts", F.col("ts").cast("timestamp"))
    return intake.run_to_table(jobs.job_windows(log), "windows")


@query
def job_sessions(spark, d):
    return jobs.job_sessions(fx.job_log(spark, d))


@query
def job_retention(spark, d):
    return jobs.job_retention(fx.job_log(spark, d), F.expr(f"TIMESTAMP_NTZ '{fx.AS_OF}'"))


@query
def job_stats(spark, d):
    return jobs.job_stats(fx.job_log(spark, d))


@query
def progress_phase(spark, d):
    rows = fx.job_log(spark, d)
    return rows.select("event_id", "progress", jobs.progress_phase(F.col("progress")).alias("phase"))


@query
def job_latest(spark, d):
    return jobs.job_latest(fx.job_log(spark, d))


# -- the whole way -------------------------------------------------------------------------------------------------------------------

def top_cited_laws(spark: SparkSession, d: str) -> DataFrame:
    """Documents to the most cited laws: extract, de-duplicate, normalise, look up, count."""
    mentions = dedupe.dedupe_exact(extract.extract(fx.cited_documents(spark, d)))
    known = registry.validate_mentions(normalize.normalize_law(filters.threshold(mentions, 70, 0)))
    return (
        known.where("validated")
        .groupBy("boe_id")
        .agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("docs"))
        .orderBy(F.desc("mentions"), "boe_id")
    )


QUERIES["top_cited_laws"] = top_cited_laws


_WHOLE = [
    "doc_id", "mention_id", "agent", "kind", "text", "law", "article", "start", "confidence", "celex", "law_norm", "boe_id",
    "article_exists", "validated", "reason", "key",
]


def _whole(spark, d):
    articles = fx.project(fx.read(spark, d, "part"), fx.REGISTRY_ARTICLES)
    return whole.found_mentions(fx.cited_documents(spark, d), articles).select(*_WHOLE)


@query
def pipeline_mentions(spark, d):
    return whole.accepted(_whole(spark, d))


@query
def pipeline_consensus(spark, d):
    return consensus.consensus(_whole(spark, d))


@query
def pipeline_audit(spark, d):
    rows = cut_lineage(whole.accepted(_whole(spark, d)))
    return report.audit_report(audit.audit(rows), rows)


@query
def pipeline_report(spark, d):
    verified = cut_lineage(filters.exportable(whole.accepted(_whole(spark, d))))
    return report.report_markdown(verified.withColumn("eu_url", legal.eu_url(F.col("celex"), F.lit("ES"))), "01/01/2024 00:00", TEXT_WIDTH)
