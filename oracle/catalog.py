"""DuckDB twin of every query that SQL can state over whole tables."""

from __future__ import annotations

from citelake import dims
from citelake.operators import extract, requests
from citelake.plans import fixtures as fx
from oracle import sql as s
from oracle.sql import ctes, q

ORACLE: dict[str, str] = {}


def _facts(body: str, **parts: str) -> str:
    return ctes(facts=s.FACTS, **parts) + body


def _docs(body: str, **parts: str) -> str:
    return ctes(docs=s.CITED, **parts) + body


MD5ID = "sha256(concat_ws('|', doc_id, agent, start, text))"

# -- sources and sinks ----------------------------------------------------------------

ORACLE["topic_json_scan"] = "SELECT page_id, html FROM pages"
ORACLE["topic_json_rescue"] = (
    "SELECT page_id, rescued, md5(h) AS html_md5, CAST(length(h) AS INTEGER) AS n FROM (SELECT page_id,"
    " CASE page_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'field' ELSE 'heading' END AS rescued,"
    " CASE page_id % 3 WHEN 0 THEN 'pagina ' || url || ' ' || html WHEN 1 THEN html ELSE regexp_extract(html, '(?s)<h1[^>]*>.*</h1>') END AS h FROM pages)"
)
ORACLE["text_decode_fallback"] = "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, md5(text) AS text_md5 FROM documents"
ORACLE["text_to_topic_html"] = ctes(docs=fx.sql("documents", fx.PARAGRAPH_DOCUMENTS)) + (
    "SELECT doc_id, '<div class=\"documento-estudiante\">' || chr(10) || '<h1>' || source || '</h1>' || chr(10)"
    " || array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10) || chr(10)),"
    " lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''),"
    " lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), '') || chr(10) || '</div>' AS html FROM docs"
)
_ALIASES = (
    "SELECT alias, meaning, min(pos) AS ord FROM (SELECT replace(upper(trim(alias)), '.', '') AS alias, trim(meaning) AS meaning, pos"
    " FROM raw) WHERE alias <> '' AND meaning <> '' GROUP BY alias, meaning"
)
_ALIAS_DIM = "SELECT a.*, count(*) OVER (PARTITION BY alias) AS meanings FROM (" + _ALIASES + ") a"
_RAW_ALIASES = fx.sql("part", fx.ALIAS_ROWS)
ORACLE["alias_dictionary"] = ctes(raw=_RAW_ALIASES) + _ALIAS_DIM
_PRIORITY = [
    (a, law, title, i, "alta", n) for n, (a, (law, title, i)) in enumerate(dims.PRIORITY_ACRONYMS.items())
]
_ALIAS_LAWS = (
    "SELECT alias, law, description, boe_id, priority, CAST(ord AS BIGINT) AS ord FROM "
    + s.values(_PRIORITY, "alias, law, description, boe_id, priority, ord")
    + " UNION ALL SELECT trim(alias), regexp_extract(meaning, 'Ley\\s+(?:Orgánica\\s+)?\\d+/\\d{4}'), trim(meaning), NULL, 'media', pos + "
    + str(len(_PRIORITY))
    + " FROM raw WHERE regexp_matches(meaning, 'Ley\\s+(?:Orgánica\\s+)?\\d+/\\d{4}') AND trim(alias) NOT IN ("
    + ", ".join(q(p[0]) for p in _PRIORITY) + ")"
)
ORACLE["alias_laws"] = ctes(raw=_RAW_ALIASES) + _ALIAS_LAWS
ORACLE["law_index_scan"] = (
    "SELECT p_partkey, 0 AS block_no, 'a' || p_partkey AS id, 'Artículo ' || p_partkey || '. ' || p_name AS titulo FROM part"
    " UNION ALL SELECT p_partkey, 1, 'ti', 'TÍTULO ' || p_type FROM part WHERE p_size % 2 <> 0"
)
ORACLE["registry_search_pick"] = ctes(items=fx.sql("part", fx.SEARCH_XML)) + (
    "SELECT p_partkey, kind, CASE WHEN p_size % 2 = 0 AND (p_size % 3 = 0 OR kind IN ('Ley', 'Orden')) THEN 'BOE-B-2001-' || p_partkey"
    " WHEN kind IN ('Ley', 'Orden') THEN 'BOE-A-2015-' || p_partkey ELSE 'BOE-A-1999-' || p_partkey END AS boe_id FROM items"
)
ORACLE["article_block_parse"] = (
    "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 'Artículo ' || p_partkey END AS title,"
    " CASE WHEN p_size % 5 <> 0 THEN 'Uno.' || chr(10) || p_name END AS body FROM part"
)
ORACLE["eu_metadata_parse"] = (
    "SELECT p_partkey, p_size % 4 <> 0 AS act_exists, CASE WHEN p_size % 4 <> 0 THEN 'http://w/' || p_partkey END AS work_uri,"
    " CASE WHEN p_size % 4 <> 0 THEN p_name END AS title, CASE WHEN p_size % 4 <> 0 THEN '2016-04-27' END AS date,"
    " CAST(NULL AS VARCHAR) AS type FROM part"
)
_LATEST = (
    "SELECT cache_key, ts, event_id, value FROM cache QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, event_id DESC) = 1"
)
ORACLE["cache_upsert_latest"] = ctes(cache=fx.sql("events", fx.LOOKUP_CACHE)) + _LATEST
ORACLE["cache_upsert_stored"] = ORACLE["cache_upsert_latest"]
ORACLE["stream_cache_upsert"] = ORACLE["cache_upsert_latest"]
ORACLE["cache_ttl_filter"] = ctes(cache=fx.sql("events", fx.LOOKUP_CACHE)) + (
    f"SELECT * FROM ({_LATEST}) WHERE ts >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 2 DAYS"
)
ORACLE["request_key"] = _docs("SELECT doc_id, 'extract_' || md5(text) AS request_key FROM docs")

_MD_HEAD = (
    "SELECT doc_id, 0 AS section, CAST(0 AS BIGINT) AS seq, '# REFERENCIAS LEGALES EXTRAÍDAS' || chr(10) || chr(10) || '**Tema:** ' || doc_id"
    " || chr(10) || '**Fecha:** 01/01/2024 00:00' || chr(10) || '**Total referencias verificadas:** ' || verified || chr(10)"
    " || CASE WHEN inferred > 0 THEN '**Total referencias inferidas (BETA):** ' || inferred || chr(10) ELSE '' END"
    " || chr(10) || '---' || chr(10) || chr(10) || '# 📋 SECCIÓN 1: REFERENCIAS VERIFICADAS' || chr(10) || chr(10)"
    " || 'Estas referencias han sido extraídas directamente del texto y validadas contra el BOE oficial.' || chr(10) || chr(10) || '---' || chr(10) AS block"
)
_MD_BODY = (
    "SELECT doc_id, 1 AS section, seq, '## ' || seq || '. ' || text || chr(10) || chr(10)"
    " || CASE WHEN boe_id IS NOT NULL THEN '**BOE-ID:** ' || boe_id || chr(10) || '**BOE URL:** [' || url || '](' || url || ')' || chr(10) || chr(10)"
    " ELSE '' END || '---' || chr(10) AS block FROM numbered"
)
_NUMBERED = (
    f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS seq, {q(dims.REGISTRY_URL)} || boe_id AS url FROM verified"
)
ORACLE["report_markdown"] = _facts(
    f"{_MD_HEAD} FROM (SELECT doc_id, count(*) AS verified, 0 AS inferred FROM verified GROUP BY doc_id) UNION ALL {_MD_BODY}",
    verified=f"SELECT * FROM facts WHERE {s.EXPORTABLE}",
    numbered=_NUMBERED,
)
_TXT = "'" + "=" * 80 + "'"
ORACLE["report_text"] = _facts(
    f"SELECT doc_id, 0 AS section, CAST(0 AS BIGINT) AS seq, {_TXT} || chr(10) || 'REFERENCIAS LEGALES EXTRAÍDAS' || chr(10) || {_TXT} || chr(10)"
    f" || chr(10) || 'Tema: ' || doc_id || chr(10) || 'Fecha: 01/01/2024 00:00' || chr(10) || 'Total referencias verificadas: ' || count(*) || chr(10)"
    f" || chr(10) || {_TXT} || chr(10) || chr(10) || 'SECCIÓN 1: REFERENCIAS VERIFICADAS' || chr(10) || chr(10)"
    f" || 'Estas referencias han sido extraídas directamente del texto y validadas' || chr(10) || 'contra el BOE oficial.' || chr(10) || chr(10)"
    f" || {_TXT} || chr(10) AS block FROM verified GROUP BY doc_id"
    f" UNION ALL SELECT doc_id, 9, 0, {_TXT} FROM (SELECT DISTINCT doc_id FROM verified)"
    " UNION ALL SELECT doc_id, 1, seq, repeat('-', 80) || chr(10) || seq || '. ' || text || chr(10) || repeat('-', 80) || chr(10) || chr(10)"
    " || CASE WHEN boe_id IS NOT NULL THEN 'BOE-ID: ' || boe_id || chr(10) || 'BOE URL: ' || url || chr(10) || chr(10) ELSE '' END FROM numbered",
    verified=f"SELECT * FROM facts WHERE {s.EXPORTABLE}",
    numbered=_NUMBERED,
)
_RESULT = (
    "SELECT doc_id, mention_id, coalesce(text, '') AS text, coalesce(kind, 'desconocido') AS kind, law, article,"
    " coalesce(confidence, 0) AS confidence, coalesce(validated, false) AS validated, boe_id, agent AS found_by,"
    f" {q(dims.REGISTRY_URL)} || boe_id AS boe_url,"
    f" {q(dims.REGISTRY_URL)} || boe_id || coalesce('#a' || nullif(article, ''), '') AS article_url FROM facts"
)
ORACLE["project_result"] = _facts(_RESULT)


def _json(fields: list[tuple[str, str]]) -> str:
    """JSON text of a row without its null fields."""
    parts = []
    for name, kind in fields:
        value = f"'\"' || {name} || '\"'" if kind == "s" else f"CAST({name} AS VARCHAR)"
        parts.append(f"CASE WHEN {name} IS NOT NULL THEN '\"{name}\":' || {value} END")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_FIELDS = [("text", "s"), ("kind", "s"), ("law", "s"), ("article", "s"), ("confidence", "n"), ("validated", "n"), ("boe_id", "s"),
           ("found_by", "s"), ("boe_url", "s"), ("article_url", "s")]
ORACLE["report_json"] = _facts(f"SELECT doc_id, mention_id, {_json(_FIELDS)} AS json FROM ({_RESULT})")
_SEGS = ctes(pages_raw="SELECT page_id, html FROM pages", seg=s.segments("pages_raw"))
ORACLE["sanitize_name"] = _SEGS + (
    "SELECT page_id, substr(regexp_replace(replace(text, ' ', '_'), '[^\\p{L}\\p{N}_-]', '', 'g'), 1, 50) AS name FROM seg WHERE tag = 'h1'"
    " QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1"
)

# -- text preparation --------------------------------------------------------------------

_CLEAN = (
    "SELECT page_id, regexp_replace(regexp_replace(string_agg(CASE WHEN tag IN ('h1', 'h2') THEN chr(10) || chr(10) || text || chr(10)"
    " WHEN tag = 'h3' THEN chr(10) || text || chr(10) WHEN tag = 'p' THEN text || chr(10) ELSE '- ' || text || chr(10) END, '' ORDER BY pos),"
    " '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM seg"
    " WHERE tag IN ('h1', 'h2', 'h3', 'p', 'li') AND text <> '' GROUP BY page_id"
)
_OUTLINED = dict(src=s.pages(fx.PLANTED_OUTLINE), seg=s.segments("src"))
ORACLE["html_clean_text"] = ctes(**_OUTLINED) + _CLEAN
ORACLE["html_doc_stats"] = ctes(**_OUTLINED) + (
    "SELECT page_id, CAST(length(text) AS INTEGER) AS total_chars,"
    " CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS total_lines, has_h1, has_h2,"
    f" CAST(n_paragraphs AS INTEGER) AS n_paragraphs FROM ({_CLEAN}) JOIN (SELECT page_id, bool_or(tag = 'h1') AS has_h1, bool_or(tag = 'h2') AS has_h2,"
    " count(*) FILTER (tag = 'p') AS n_paragraphs FROM seg GROUP BY page_id) USING (page_id)"
)
ORACLE["html_outline"] = ctes(**_OUTLINED, heads=(
    "SELECT *, sum(CASE WHEN tag = 'h2' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS num FROM seg WHERE tag IN ('h2', 'h3')"
)) + (
    "SELECT page_id, main_title, CAST(num AS INTEGER) AS num, max(text) FILTER (tag = 'h2') AS title,"
    " coalesce(string_agg(text, ' | ' ORDER BY pos) FILTER (tag = 'h3'), '') AS subs FROM heads JOIN (SELECT page_id, min_by(text, pos) AS main_title"
    " FROM seg WHERE tag = 'h1' GROUP BY page_id) USING (page_id) WHERE num > 0 GROUP BY page_id, main_title, num"
)
ORACLE["strip_tags"] = f"SELECT page_id, {s.stripped('html')} AS text FROM pages"
ORACLE["truncate_text"] = _docs(
    "SELECT doc_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS text_md5, truncated FROM (SELECT doc_id, length(text) > 50000 AS truncated,"
    " CASE WHEN length(text) > 50000 THEN substr(text, 1, 50000) || chr(10) || chr(10) || '[... texto truncado ...]' ELSE text END AS t FROM docs)"
)


def _chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * {step} AS INTEGER) AS start, substr(text, i * {step} + 1, {size}) AS chunk FROM docs,"
        f" unnest(range(0, CAST(greatest(ceil((length(text) - {overlap}) / CAST({step} AS DOUBLE)), 1) AS BIGINT))) AS u(i)"
    )


ORACLE["chunk_documents"] = _docs(
    f"SELECT doc_id, chunk_no, start, CAST(length(chunk) AS INTEGER) AS n, md5(chunk) AS chunk_md5 FROM ({_chunks(2000, 200)})"
)
ORACLE["clean_reference"] = ctes(rows=fx.sql("lineitem", fx.RAW_REFERENCES)) + (
    f"SELECT mention_id, {s.clean_reference('raw')} AS ref FROM rows"
)

# -- extraction ------------------------------------------------------------------------------

for _a in "ABC":
    ORACLE[f"extract_profile_{_a.lower()}"] = _docs(s.mentions(_a))
ORACLE["extract_all_profiles"] = _docs(s.mentions())
_AL = q("(?i)" + extract.ARTICLE_LAW)
_ARTICLE_LAW = f"SELECT doc_id, start, text, regexp_extract(text, {_AL}, 1) AS article, regexp_extract(text, {_AL}, 2) AS law FROM ({s.hits('docs', extract.ARTICLE_LAW)})"
ORACLE["extract_article_law"] = _docs(_ARTICLE_LAW)
ORACLE["explode_multi_article"] = ctes(rows=fx.sql("lineitem", fx.ARTICLE_LISTS)) + (
    "SELECT mention_id, article, CAST(i - 1 AS INTEGER) AS article_idx, n[i] AS article_one FROM (SELECT *, CASE WHEN article LIKE '% y %'"
    " OR article LIKE '%,%' THEN regexp_extract_all(article, '\\d+') ELSE [article] END AS n FROM rows), unnest(range(1, len(n) + 1)) AS u(i)"
)
ORACLE["mention_context"] = _docs(
    "SELECT doc_id, mention_id, text, CAST(place AS INTEGER) AS place, CASE WHEN b > 0 THEN '...' ELSE '' END || substr(body, b + 1, e - b)"
    " || CASE WHEN e < length(body) THEN '...' ELSE '' END AS context FROM (SELECT *, greatest(place - 1 - 1500, 0) AS b,"
    " least(length(body), place - 1 + 1500) AS e FROM (SELECT m.doc_id, m.mention_id, m.text, d.text AS body, m.start + 1 AS place"
    f" FROM ({s.mentions()}) m JOIN docs d ON m.doc_id = d.doc_id))"
)
ORACLE["drop_caselaw"] = ctes(rows=fx.sql("lineitem", fx.NOISY_MENTIONS)) + (
    "SELECT * FROM rows WHERE NOT regexp_matches(text, '\\bST[CS]\\b') AND NOT regexp_matches(text, '(?i)^\\s*(?:la|el)\\s+(?:ley|norma|código|reglamento)\\s*$')"
)
ORACLE["flag_contextual"] = _docs(
    "SELECT doc_id, " + " OR ".join(f"contains(lower(text), {q(p)})" for p in dims.CONTEXTUAL_PHRASES) + " AS contextual FROM docs"
)
ORACLE["flag_eu"] = _docs(f"SELECT doc_id, regexp_matches(text, {s.EU_PATTERN}) AS eu FROM docs")
_BATCHED = "SELECT *, CAST((rn - 1) // {n} AS INTEGER) AS batch_id, CAST((rn - 1) % {n} + 1 AS INTEGER) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS rn FROM {src})"
_ASKED = (
    "SELECT doc_id, batch_id, count(*) AS mentions, string_agg(idx || '. ' || text || coalesce(' | ' || law, ''), chr(10) ORDER BY idx) AS body FROM ({b}) GROUP BY doc_id, batch_id"
)
_OPEN = "SELECT * FROM facts WHERE coalesce(confidence, 100) < 100"
ORACLE["model_requests"] = _facts(
    "SELECT doc_id, batch_id, mentions, body, 'context_' || md5(body) AS request_key FROM asked WHERE md5(body) NOT IN (SELECT md5(body) FROM answered)",
    open_rows=_OPEN,
    asked=_ASKED.format(b=_BATCHED.format(n=10, src="open_rows")),
    done="SELECT * FROM open_rows WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    answered=_ASKED.format(b=_BATCHED.format(n=10, src="done")),
)
ORACLE["extraction_requests"] = _docs(
    "SELECT doc_id, chunk_no, start, CAST(length(body) AS INTEGER) AS chars, 'extract_' || md5(body) AS request_key FROM (SELECT c.doc_id, chunk_no, start,"
    " chunk || coalesce(chr(10) || chr(10) || 'REFERENCIAS YA ENCONTRADAS:' || chr(10) || known, '') || chr(10) || chr(10) || " + q(requests.acronym_hints()) + " AS body"
    f" FROM ({_chunks(50_000, 500)}) c LEFT JOIN known k ON c.doc_id = k.doc_id)",
    prev=f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, mention_id) AS n FROM ({s.mentions('B')})",
    known="SELECT doc_id, string_agg('- ' || text, chr(10) ORDER BY n) FILTER (n <= 10) || CASE WHEN count(*) > 10 THEN chr(10) || '... y más' ELSE '' END AS known FROM prev GROUP BY doc_id",
)
_BROKEN = (
    "SELECT o_orderkey AS doc_id, 'Ley ' || n || '/2015' AS text, '```json {\"referencias\": [{\"texto_completo\": \"' AS pre, n FROM"
    " (SELECT o_orderkey, o_custkey % 40 + 1 AS n FROM orders WHERE o_orderkey % 7 = 0)"
)
ORACLE["model_responses_parse"] = (
    "SELECT o_orderkey AS doc_id, 0 AS idx, 'Ley ' || (o_custkey % 40 + 1) || '/2015' AS text, 'ley' AS kind, 'Ley ' || (o_custkey % 40 + 1) || '/2015' AS law,"
    " NULL AS article, 95 AS confidence, false AS fallback FROM orders WHERE o_orderkey % 7 <> 0"
    " UNION ALL SELECT o_orderkey, 1, 'artículo ' || (o_custkey % 40 + 1) || ' CE', 'articulo', 'CE', CAST(o_custkey % 40 + 1 AS VARCHAR), 80, false FROM orders WHERE o_orderkey % 7 <> 0"
    f" UNION ALL SELECT doc_id, CAST(length(pre) AS INTEGER), text, 'ley', n || '/2015', NULL, 80, true FROM ({_BROKEN})"
    f" UNION ALL SELECT doc_id, CAST(length(pre) + length(text) + length('\", \"tipo\": \"ley\", \"ley\": \"') AS INTEGER), text, 'ley', n || '/2015', NULL, 80, true FROM ({_BROKEN})"
)
_LOOSE = "'(?is)^(.*?)' || replace(replace(replace(m, '.', chr(92) || '.?'), ' ', chr(92) || 's+'), '/', '/')"
ORACLE["locate_mentions"] = ctes(docs=fx.sql("documents", fx.ANSWERED_DOCUMENTS), wanted=(
    "SELECT doc_id, text AS body, unnest(['Ley ' || CAST(doc_id % 40 + 1 AS VARCHAR) || '/2015', 'art. ' || CAST(doc_id % 40 + 1 AS VARCHAR) || ' C.E.', 'Ley 77/1777']) AS m FROM docs"
), placed=(
    f"SELECT *, CASE WHEN instr(lower(body), lower(m)) > 0 THEN instr(lower(body), lower(m)) WHEN regexp_matches(body, {_LOOSE}) THEN length(regexp_extract(body, {_LOOSE}, 1)) + 1 ELSE 0 END AS place FROM wanted"
)) + (
    "SELECT doc_id, m AS text, CAST(place AS INTEGER) AS place, CASE WHEN place > 0 THEN CASE WHEN place > 41 THEN '...' ELSE '' END || substr(body, greatest(place - 40, 1), place - 1 + 40 - greatest(place - 41, 0))"
    " || CASE WHEN place + 39 < length(body) THEN '...' ELSE '' END END AS context FROM placed"
)
ORACLE["request_usage"] = ctes(calls=fx.sql("events", fx.MODEL_CALLS)) + (
    "SELECT agent, count(*) AS calls, CAST(sum(length(prompt) // 4) AS BIGINT) AS tokens, count(*) FILTER (failed) AS errors, round(avg(ms), 6) AS mean_ms FROM calls GROUP BY agent"
)

# -- filters -------------------------------------------------------------------------------------

ORACLE["threshold_default100"] = _facts("SELECT * FROM facts WHERE coalesce(confidence, 100) >= 70")
ORACLE["threshold_default0"] = _facts(
    "SELECT doc_id, count(*) FILTER (coalesce(confidence, 0) >= 70) AS kept, count(*) FILTER (coalesce(confidence, 0) < 70) AS dropped FROM facts GROUP BY doc_id"
)
ORACLE["exportable"] = ctes(docs=s.CITED, facts=s.FACTS) + (
    f"SELECT doc_id, CAST(start AS BIGINT) AS start, text FROM ({s.EU_HITS}) WHERE regexp_matches(text, {q(s.EXPORT_WORDS)})"
    f" UNION ALL SELECT doc_id, start, text FROM facts WHERE {s.EXPORTABLE}"
)
ORACLE["search_mentions"] = _facts(
    "SELECT doc_id, mention_id, text, law, article FROM facts WHERE contains(lower(text), 'ley 1') OR coalesce(contains(lower(law), 'ley 1'), false) OR coalesce(contains(lower(article), 'ley 1'), false)"
)
ORACLE["distinct_kinds"] = _facts("SELECT DISTINCT kind FROM facts")
ORACLE["sort_mentions"] = _facts("SELECT mention_id, confidence, kind, law FROM facts ORDER BY coalesce(confidence, 0) DESC, mention_id")
ORACLE["topk_per_doc"] = _facts(
    "SELECT doc_id, mention_id, CAST(r AS INTEGER) AS rank, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(confidence, 0) DESC, mention_id) AS r FROM facts) WHERE r <= 3"
)
ORACLE["split_incomplete"] = _facts(
    "SELECT doc_id, coalesce(confidence, 100) < 100 AS incomplete, count(*) AS mentions FROM facts GROUP BY ALL"
)

# -- de-duplication and convergence -----------------------------------------------------------------

ORACLE["dedupe_exact"] = _facts(
    f"SELECT * FROM facts WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(text)) ORDER BY {s.RANK}, start, mention_id) = 1"
)


def _previous(agent: str, key: str) -> str:
    return _facts(
        f"SELECT * FROM new n WHERE {key} <> '' AND NOT EXISTS (SELECT 1 FROM prev p WHERE p.doc_id = n.doc_id AND p.k = {key})"
        f" QUALIFY row_number() OVER (PARTITION BY doc_id, {key} ORDER BY start, mention_id) = 1",
        new=f"SELECT * FROM facts WHERE agent = '{agent}' AND round > 1",
        prev=f"SELECT DISTINCT doc_id, {key} AS k FROM facts n WHERE round = 1",
    )


ORACLE["dedupe_prev_a"] = _previous("A", "lower(trim(n.text))")
ORACLE["dedupe_prev_c"] = _previous("C", "trim(regexp_replace(lower(n.text), '\\s+', ' ', 'g'))")


def _greedy(source: str, vals: str, seen0: str | None = None, **parts: str) -> str:
    """The one-by-one rule: walk a document's mentions in order with the list of values seen so far."""
    start = "[]::VARCHAR[]" if seen0 is None else f"coalesce((SELECT list(k) FROM {seen0} z WHERE z.doc_id = i.doc_id), []::VARCHAR[])"
    return "WITH RECURSIVE " + ctes(facts=s.FACTS, **parts, items=(
        f"SELECT doc_id, mention_id, list_filter({vals}, lambda v: v IS NOT NULL) AS vals, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS rn FROM {source}"
    ))[5:].rstrip() + (
        f", walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, {start} AS seen, CAST(NULL AS VARCHAR) AS kept FROM (SELECT DISTINCT doc_id FROM items) i"
        " UNION ALL SELECT w.doc_id, i.rn, CASE WHEN list_has_any(w.seen, i.vals) THEN w.seen ELSE list_concat(w.seen, i.vals) END,"
        " CASE WHEN list_has_any(w.seen, i.vals) THEN NULL ELSE i.mention_id END FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.rn = w.rn + 1)"
        f" SELECT f.* FROM {source} f JOIN walk w ON w.kept = f.mention_id"
    )


ORACLE["dedupe_prev_b"] = _greedy(
    "new", "[lower(trim(text)), nullif(lower(trim(law)), '')]", "prev",
    new="SELECT * FROM facts WHERE agent = 'B' AND round > 1",
    prev="SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest([lower(trim(text)), lower(trim(law))]) AS k FROM facts WHERE round = 1) WHERE k IS NOT NULL AND k <> ''",
)
ORACLE["dedupe_text_or_law"] = _greedy("facts", "['t:' || lower(trim(text)), 'l:' || nullif(lower(trim(law)), '')]")
ORACLE["dedupe_canonical"] = _facts(
    f"SELECT * FROM (SELECT *, {s.canonical_key()} AS key FROM facts) QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY {s.RANK}, start, mention_id) = 1"
)
ORACLE["attribute_agent"] = _facts(
    f"SELECT doc_id, lower(trim(text)) AS key, min_by(agent, {s.RANK}) AS agent, count(*) AS copies FROM facts GROUP BY 1, 2"
)
ORACLE["dedupe_semantic"] = _docs(
    "SELECT doc_id, key, text, agent, start FROM (SELECT *, strip_accents(regexp_replace(lower(identity), '\\s+', '', 'g'))"
    f" || coalesce(':art' || nullif({s.normal_article('article')}, ''), '') AS key, {MD5ID} AS mention_id FROM named)"
    f" QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY length(text) DESC, {s.RANK}, start, mention_id) = 1",
    found=f"SELECT doc_id, start, text, article, law, 'C' AS agent FROM ({_ARTICLE_LAW}) UNION ALL"
    f" SELECT doc_id, start, text, article, coalesce({s.law_form('text')[0]}, text), agent FROM ({s.mentions('AC')})",
    refs="SELECT *, law AS ref, CAST(NULL AS VARCHAR) AS title FROM found",
    ids=s.registry_ids("refs"),
    named=f"SELECT ids.*, coalesce(boe_id, e.v, law) AS identity FROM ids LEFT JOIN {s.mapping(dims.EU_CELEX)} e ON law = e.k",
)
ORACLE["near_dup_names"] = ctes(names=fx.sql("part", fx.NAME_SPELLINGS), marked=(
    "SELECT law_name, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(strip_accents(lower(law_name)), '[^a-z0-9/ ]+', ' ', 'g')), '\\s+'),"
    " lambda w: w <> '' AND w NOT IN ('de', 'del', 'la', 'las', 'el', 'los', 'y', 'of', 'the')))), ' ') AS fingerprint FROM names"
), prints="SELECT DISTINCT fingerprint AS f, string_split(fingerprint, ' ') AS w FROM marked", words=(
    "SELECT f, x, array_to_string(list_filter(w, lambda y: y <> x), ' ') AS rest FROM (SELECT f, w, unnest(w) AS x FROM prints)"
), links=(
    "SELECT a.f AS f, b.f AS g FROM words a JOIN words b ON a.rest = b.rest AND a.x <> b.x AND abs(length(a.x) - length(b.x)) <= 1 AND levenshtein(a.x, b.x) = 1"
    " AND regexp_full_match(a.x, '[a-z]{4,}') AND regexp_full_match(b.x, '[a-z]{4,}')"
), reach="SELECT f, f AS g FROM prints UNION SELECT r.f, l.g FROM reach r JOIN links l ON r.g = l.f", roots=(
    "SELECT f, min(g) AS fingerprint FROM reach GROUP BY f"
)).replace("WITH ", "WITH RECURSIVE ", 1) + (
    "SELECT r.fingerprint, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS mentions, first(law_name ORDER BY n DESC, law_name) AS name FROM"
    " (SELECT fingerprint, law_name, count(*) AS n FROM marked GROUP BY 1, 2) m JOIN roots r ON m.fingerprint = r.f GROUP BY r.fingerprint"
)
ORACLE["converge_mentions"] = _docs(
    "SELECT doc_id, key, CAST(min(round) AS INTEGER) AS round FROM (SELECT * FROM base UNION ALL SELECT doc_id, v, 4 FROM base JOIN edges ON key = k"
    " UNION ALL SELECT b.doc_id, f.v, 5 FROM base b JOIN edges e ON b.key = e.k JOIN edges f ON e.v = f.k"
    " UNION ALL SELECT b.doc_id, g.v, 6 FROM base b JOIN edges e ON b.key = e.k JOIN edges f ON e.v = f.k JOIN edges g ON f.v = g.k) GROUP BY 1, 2",
    base=f"SELECT doc_id, lower(trim(text)) AS key, min({s.RANK}) AS round FROM ({s.mentions()}) GROUP BY 1, 2",
    edges=f"SELECT k, v FROM {s.mapping(fx.ALIAS_EDGES)}",
)
_HISTORY = (
    "SELECT doc_id, round, candidates, unique_texts, new_texts, CAST(sum(new_texts) OVER (PARTITION BY doc_id ORDER BY round) AS BIGINT) AS accumulated, new_texts = 0 AS converged"
    " FROM (SELECT f.doc_id, f.round, count(*) AS candidates, count(DISTINCT lower(trim(text))) AS unique_texts,"
    " count(DISTINCT CASE WHEN f.round = first THEN lower(trim(text)) END) AS new_texts FROM facts f JOIN (SELECT doc_id, lower(trim(text)) AS k, min(round) AS first"
    " FROM facts GROUP BY 1, 2) m ON f.doc_id = m.doc_id AND lower(trim(f.text)) = m.k GROUP BY 1, 2)"
)
ORACLE["round_history"] = _facts(_HISTORY)
ORACLE["convergence_stats"] = _facts(
    "SELECT agent, round, count(*) AS mentions, round(avg(coalesce(confidence, 0)), 6) AS mean_confidence, CAST(grouping_id(agent, round) AS INTEGER) AS level FROM facts GROUP BY ROLLUP (agent, round)"
)

# -- resolution ---------------------------------------------------------------------------------------

_LAWS_OF_C = f"SELECT * REPLACE (coalesce({s.law_form('text')[0]}, text) AS law) FROM ({s.mentions('C')})"


def _principal(source: str, share: int) -> str:
    return (
        f"SELECT *, CASE WHEN confidence >= {share} THEN top_law END AS principal_law FROM (SELECT doc_id, first(law ORDER BY n DESC, law) AS top_law, max(n) AS top_count,"
        f" CAST(sum(n) AS BIGINT) AS law_mentions, CAST(floor(100 * max(n) / sum(n)) AS INTEGER) AS confidence FROM (SELECT doc_id, law, count(*) AS n FROM {source} WHERE law IS NOT NULL GROUP BY 1, 2) GROUP BY doc_id)"
    )


ORACLE["principal_law"] = _docs(_principal("named", 80), named=_LAWS_OF_C)
ORACLE["resolve_second_pass"] = _facts(
    "SELECT doc_id, mention_id, CASE WHEN fits THEN principal_law ELSE law END AS law, CASE WHEN fits THEN 100 WHEN coalesce(confidence, 0) >= 95 THEN 100 ELSE coalesce(confidence, 0) END AS confidence,"
    " fits AS resolved FROM (SELECT f.*, p.principal_law, f.law IS NULL AND p.principal_law IS NOT NULL AS fits FROM facts f LEFT JOIN p ON f.doc_id = p.doc_id)",
    p=_principal("facts", 50),
)
ORACLE["resolve_anaphora"] = _docs(
    "SELECT doc_id, start, text, resolved_law FROM (SELECT *, last_value(law IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS resolved_law"
    f" FROM (SELECT doc_id, start, text, law FROM ({_LAWS_OF_C}) UNION ALL SELECT doc_id, start, text, NULL FROM ({s.hits('docs', extract.ANAPHORA)}))) WHERE law IS NULL"
)
ORACLE["resolve_prev_article"] = _facts(
    "SELECT doc_id, mention_id, article, last_value(article IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_article FROM facts"
)
_RESOLVED = (
    "SELECT b.doc_id, b.mention_id, b.batch_id, b.idx, CASE WHEN hit THEN a_law ELSE law END AS law, CASE WHEN hit THEN coalesce(a_conf, 90) ELSE confidence END AS confidence,"
    " hit AS resolved, CASE WHEN hit THEN reason END AS reason, confidence AS before FROM (SELECT b.*, a.law AS a_law, a.confidence AS a_conf, a.reason, a.law IS NOT NULL AS hit"
    " FROM batched b LEFT JOIN answers a ON b.doc_id = a.doc_id AND b.batch_id = a.batch_id AND b.idx = a.idx) b"
)
_BATCHES = dict(batched=_BATCHED.format(n=10, src="facts"), answers=fx.sql("batched", fx.ANSWERS))
ORACLE["apply_resolutions"] = _facts(f"SELECT * EXCLUDE (before) FROM ({_RESOLVED})", **_BATCHES)
ORACLE["resolution_metrics"] = _facts(
    "SELECT count(*) AS total, count(*) FILTER (coalesce(before, 100) < 100) AS incomplete, count(*) FILTER (coalesce(before, 100) < 100 AND resolved) AS resolved,"
    " round(avg(before) FILTER (coalesce(before, 100) < 100), 6) AS confidence_before, round(avg(coalesce(confidence, 100)) FILTER (coalesce(before, 100) < 100), 6) AS confidence_after"
    f" FROM ({_RESOLVED})", **_BATCHES,
)
_FULL_TITLES = sorted({k for a, (law, _, _) in dims.PRIORITY_ACRONYMS.items() for k in (a.upper(), law.upper())})
ORACLE["resolve_titles"] = _docs(
    "SELECT doc_id, mention_id, text, t.v AS title, t.v IS NOT NULL AS title_resolved, CASE WHEN t.v IS NULL THEN 0 WHEN key IN ("
    + ", ".join(q(k) for k in _FULL_TITLES)
    + f") THEN 100 ELSE 90 END AS title_confidence FROM (SELECT *, upper(trim(CASE WHEN kind = 'sigla' THEN text ELSE coalesce(law, text) END)) AS key FROM ({s.mentions('BC')})"
    f" WHERE kind <> 'articulo') m LEFT JOIN {s.mapping(dims.law_titles())} t ON m.key = t.k"
)

# -- normalisation ------------------------------------------------------------------------------------------

ORACLE["is_acronym"] = _facts(
    f"SELECT mention_id, kind, text, {s.is_acronym(q('ley'), 'text')} AS by_text, {s.is_acronym('kind', 'text')} AS acronym FROM facts"
)
_ACRONYMS = fx.sql("lineitem JOIN part ON l_partkey = p_partkey", fx.ACRONYM_MENTIONS)
_EXPANDED = (
    "SELECT m.*, b.alias AS acronym, b.meaning, coalesce(b.meanings, 0) > 1 AS ambiguous, nullif(regexp_extract(b.meaning, 'Ley\\s+(?:Orgánica\\s+)?\\d+/\\d{4}'), '') AS meaning_law"
    " FROM mentions m LEFT JOIN best b ON b.context = m.context AND b.alias = CASE WHEN acr THEN replace(upper(trim(m.text)), '.', '') END"
)


def _acronym_parts(dictionary: str) -> dict[str, str]:
    return dict(
        raw=_RAW_ALIASES,
        mentions=f"SELECT *, {s.is_acronym('kind', 'text')} AS acr FROM ({_ACRONYMS})",
        dictionary=dictionary,
        best=(
            "SELECT alias, context, meaning, meanings FROM (SELECT DISTINCT context, replace(upper(trim(text)), '.', '') AS alias FROM mentions WHERE acr) JOIN dictionary USING (alias)"
            " QUALIFY row_number() OVER (PARTITION BY alias, context ORDER BY len(list_intersect(list_distinct(string_split_regex(lower(meaning), '[\\s,]+')),"
            " list_distinct(string_split_regex(lower(context), '[\\s,]+')))) DESC, ord, meaning) = 1"
        ),
    )


ORACLE["expand_acronyms"] = ctes(**_acronym_parts(_ALIAS_DIM)) + f"SELECT * EXCLUDE (acr) FROM ({_EXPANDED})"
ORACLE["expand_ambiguous"] = ctes(**_acronym_parts(f"SELECT * FROM ({_ALIAS_DIM}) WHERE meanings > 1")) + (
    f"SELECT acronym, meaning, count(*) AS mentions FROM ({_EXPANDED}) WHERE ambiguous GROUP BY 1, 2"
)
ORACLE["normalize_law"] = _docs(
    f"SELECT mention_id, text, law, law_norm, law_type FROM ({s.normalized('found')})", found=s.mentions()
)
_INFORMAL = "CASE " + " ".join(
    f"WHEN regexp_matches(bare, {q('(?i)' + p)}) THEN {q(w + ' (')} || upper(regexp_extract(bare, {q('(?i)' + p)}, 1)) || ') ' || regexp_extract(bare, {q('(?i)' + p)}, 2)"
    for w, p in dims.EU_INFORMAL.items()
) + " END"


def _eu_normal(source: str) -> str:
    """source(…, text) with is_eu, celex, eu_acronym, eu_article, normal_text."""
    return (
        "SELECT * EXCLUDE (bare, informal, name, known, art, c), c AS celex, CASE WHEN c IS NOT NULL AND name IS NOT NULL THEN bare END AS eu_acronym,"
        " CASE WHEN c IS NOT NULL THEN art END AS eu_article, CASE WHEN c IS NOT NULL THEN coalesce('Artículo ' || art || ' del ' || coalesce(name, informal), name, informal, text) END AS normal_text FROM"
        f" (SELECT *, CASE WHEN is_eu THEN coalesce(known, {s.celex('coalesce(informal, text)')}) END AS c FROM"
        f" (SELECT x.*, {_INFORMAL} AS informal, n.v AS name, k.v AS known FROM (SELECT *, coalesce(regexp_matches(text, {s.EU_PATTERN}), false) AS is_eu,"
        " trim(regexp_replace(trim(text), '(?i)art(?:ículo|iculo)?\\.?\\s*\\d+\\s+del?\\s+', '', 'g')) AS bare,"
        f" nullif(regexp_extract(text, '(?i)art(?:ículo|iculo)?\\.?\\s*(\\d+)', 1), '') AS art FROM {source}) x"
        f" LEFT JOIN {s.mapping(dims.EU_ACRONYMS)} n ON bare = n.k LEFT JOIN {s.mapping(dims.EU_CELEX)} k ON bare = k.k))"
    )


ORACLE["normalize_eu"] = _docs(_eu_normal("eu"), eu=s.EU_HITS)
_EU_REFS = fx.sql("part", fx.EU_REFERENCES)
ORACLE["derive_celex"] = ctes(rows=_EU_REFS) + f"SELECT p_partkey, text, {s.celex('text')} AS celex FROM rows"
ORACLE["derive_celex_raw"] = ctes(rows=_EU_REFS) + f"SELECT p_partkey, text, {s.celex_raw('text')} AS celex FROM rows"
_NAMES = fx.sql("part", fx.LAW_NAMES)
ORACLE["celex_lookup"] = ctes(rows=_NAMES) + f"SELECT p_partkey, name, v AS celex FROM rows LEFT JOIN {s.mapping(dims.EU_CELEX)} ON name = k"
ORACLE["eu_urls"] = ctes(rows=_EU_REFS, acts=f"SELECT DISTINCT {s.celex('text')} AS celex FROM rows") + (
    f"SELECT celex, language, {q(dims.EU_URL)} || language || '/TXT/?uri=CELEX:' || celex AS txt, {q(dims.EU_URL)} || language || '/PDF/?uri=CELEX:' || celex AS pdf,"
    f" {q(dims.EU_URL)} || language || '/ALL/?uri=CELEX:' || celex AS html, {q(dims.EU_URL)} || language || '/TXT/?uri=CELEX:' || celex AS main"
    f" FROM acts, (SELECT unnest({dims.EU_LANGUAGES}) AS language) WHERE celex IS NOT NULL"
)
ORACLE["process_law_name"] = ctes(rows=_NAMES) + (
    "SELECT p_partkey, name, coalesce(e.v, l.v, name) AS expanded, e.v IS NOT NULL OR l.v IS NOT NULL AS acronym_known,"
    f" CASE WHEN e.v IS NOT NULL THEN true WHEN l.v IS NOT NULL THEN false ELSE regexp_matches(name, {s.EU_PATTERN}) END AS is_eu,"
    f" CASE WHEN e.v IS NULL AND l.v IS NOT NULL THEN i.v END AS boe_id, c.v AS celex FROM rows LEFT JOIN {s.mapping(dims.EU_ACRONYMS)} e ON name = e.k"
    f" LEFT JOIN {s.mapping(dims.LAW_ACRONYMS)} l ON name = l.k LEFT JOIN {s.mapping(dims.ACRONYM_REGISTRY_ID)} i ON name = i.k LEFT JOIN {s.mapping(dims.EU_CELEX)} c ON name = c.k"
)


def _category(kind: str) -> str:
    k = f"strip_accents(lower({kind}))"
    return f"CASE WHEN {k} IN ('ley', 'real_decreto') THEN 'normativa' WHEN {k} IN ('articulo', 'apartado') THEN 'disposicion' ELSE 'otra' END"


ORACLE["categorize"] = _facts(
    f"SELECT mention_id, kind, {_category('kind')} AS category, coalesce(boe_id <> '', false) AS has_id, coalesce(article <> '', false) AS has_article FROM facts"
)
ORACLE["normalize_article"] = ctes(m=s.LAW_MENTIONS) + f"SELECT mention_id, article, {s.normal_article('article')} AS number FROM m"


def _word(words: list[str], i: str) -> str:
    return "[" + ", ".join(q(w) for w in words) + f"][CAST({i} AS INTEGER) + 1]"


_WORDS = (
    "'a' || CASE WHEN n < 10 THEN " + _word(dims.NUMBER_WORDS_ORDINAL, "n") + " ELSE CASE WHEN n = 100 THEN 'cien' ELSE " + _word(dims.NUMBER_WORDS_HUNDREDS, "n // 100")
    + " END || CASE WHEN n % 100 < 10 THEN " + _word(dims.NUMBER_WORDS_UNITS, "n % 10") + " WHEN n % 100 < 20 THEN " + _word(dims.NUMBER_WORDS_TEENS, "n % 10")
    + " WHEN n % 100 = 20 THEN 'veinte' WHEN n % 100 < 30 THEN 'veinti' || " + _word(dims.NUMBER_WORDS_UNITS, "n % 10")
    + " WHEN n % 10 = 0 THEN " + _word(dims.NUMBER_WORDS_TENS, "n % 100 // 10") + " ELSE " + _word(dims.NUMBER_WORDS_TENS, "n % 100 // 10") + " || 'y' || "
    + _word(dims.NUMBER_WORDS_UNITS, "n % 10") + " END END"
)
ORACLE["article_word_dim"] = f"SELECT n, {_WORDS} AS block_id FROM (SELECT DISTINCT CAST(p_partkey % 1000 AS INTEGER) AS n FROM part)"
ORACLE["canonical_key"] = _facts(f"SELECT mention_id, {s.canonical_key()} AS key FROM facts")
ORACLE["acronym_to_law"] = ctes(docs=s.CITED, raw=_RAW_ALIASES, laws=_ALIAS_LAWS, first_laws="SELECT upper(trim(alias)) AS k, min_by(law, ord) AS v FROM laws GROUP BY 1") + (
    f"SELECT mention_id, text, v AS alias_law FROM (SELECT mention_id, dotted AS text FROM ({_ACRONYMS}) UNION ALL SELECT mention_id, text FROM ({s.mentions('B')}) WHERE kind = 'sigla') m"
    " LEFT JOIN first_laws ON upper(trim(m.text)) = k"
)
_LF, _LK = s.law_form("law2")
_TF, _TK = s.law_form("text")
ORACLE["normalize_mentions"] = _docs(
    "SELECT doc_id, agent, kind, text, start, law2 AS law, is_eu, celex, normal_text, law_norm, law_type, category, expanded, celex IS NOT NULL OR expanded OR law_norm IS NOT NULL AS normalized FROM"
    f" (SELECT *, CASE WHEN celex IS NULL THEN coalesce({_LF}, {_TF}) END AS law_norm, CASE WHEN celex IS NULL THEN coalesce({_LK}, {_TK}) END AS law_type, {_category('kind')} AS category FROM"
    " (SELECT *, CASE WHEN acr AND celex IS NULL THEN coalesce(al, law) ELSE law END AS law2, acr AND celex IS NULL AND al IS NOT NULL AS expanded FROM"
    f" (SELECT e.*, a.v AS al, {s.is_acronym('kind', 'text')} AS acr FROM ({_eu_normal('found')}) e LEFT JOIN {s.mapping(dims.acronym_laws())} a ON replace(upper(trim(text)), '.', '') = a.k)))",
    found=f"SELECT doc_id, agent, kind, text, law, start FROM ({s.mentions()}) UNION ALL SELECT doc_id, 'C', 'reglamento', text, NULL, start FROM ({s.EU_HITS})",
)

# -- registry and validation -----------------------------------------------------------------------------------

_INFO = dict(found=s.mentions(), normed=s.normalized("found"), info=s.law_info("normed"))
ORACLE["extract_law_info"] = _docs("SELECT mention_id, ref, ref_year FROM info", **_INFO)
ORACLE["registry_lookup"] = _docs(
    f"SELECT mention_id, ref, boe_id, found_by FROM ({s.registry_ids('refs')})",
    **_INFO, refs=f"SELECT mention_id, ref, t.v AS title FROM info LEFT JOIN {s.mapping(dims.law_titles())} t ON upper(ref) = t.k WHERE ref IS NOT NULL",
)
ORACLE["bulk_lookup"] = _facts(
    f"SELECT mention_id, ref, boe_id, found_by FROM ({s.registry_ids('refs')})",
    refs="SELECT mention_id, law AS ref, CAST(NULL AS VARCHAR) AS title FROM facts WHERE law IS NOT NULL",
)
ORACLE["registry_year_range"] = ctes(reg=fx.sql("part", fx.YEAR_REGISTRY), refs=fx.sql("lineitem", fx.YEAR_REFERENCES), asked="SELECT DISTINCT law_type, number, ref_year FROM refs", hit=(
    "SELECT a.law_type, a.number, a.ref_year, r.year AS found_year, r.boe_id FROM asked a JOIN reg r ON a.law_type = r.law_type AND a.number = r.number AND r.year BETWEEN a.ref_year - 29 AND a.ref_year"
    " QUALIFY row_number() OVER (PARTITION BY a.law_type, a.number, a.ref_year ORDER BY r.year DESC, r.boe_id) = 1"
)) + "SELECT refs.*, found_year, boe_id FROM refs LEFT JOIN hit USING (law_type, number, ref_year)"
_WORD_ID = "CASE " + " ".join(f"WHEN contains(lower(title), {q(w)}) THEN {q(i)}" for w, i in dims.TITLE_REGISTRY.items()) + " END"
_BY_TYPE = [("real decreto-ley", "Real\\s+Decreto[\\s-]+Ley"), ("real decreto legislativo", "Real\\s+Decreto\\s+Legislativo"), ("ley orgánica", "Ley\\s+Orgánica"), ("ley", "Ley"), ("real decreto", "Real\\s+Decreto"), ("real decreto", "RD")]


def _first_number(c: str, number: str, types: list) -> str:
    return "coalesce(" + ", ".join(f"{q(k + ' ')} || nullif(regexp_extract({c}, {q('(?i)' + p + chr(92) + 's+(' + number + ')')}, 1), '')" for k, p in types) + ")"


_YEARED = "\\d+/\\d{4}"
_CLEAN = s.clean_reference("ref")
ORACLE["registry_cascade"] = ctes(
    refs=fx.sql("lineitem", fx.CASCADE_REFERENCES),
    reg="SELECT lower(law_type) AS t, number, year, min(boe_id) AS id FROM (" + fx.sql("part", fx.YEAR_REGISTRY) + ") GROUP BY ALL",
    known=f"SELECT k, v FROM {s.mapping(dims.registry_entries())} UNION ALL SELECT t || ' ' || number || '/' || year, id FROM reg"
    f" WHERE t || ' ' || number || '/' || year NOT IN (SELECT k FROM {s.mapping(dims.registry_entries())})",
    asked=f"SELECT DISTINCT ref, title, ref_year, coalesce(ref_year, 2024) AS upto, {_WORD_ID} AS word, {_first_number('title', _YEARED, _BY_TYPE)} AS t, {_first_number(_CLEAN, _YEARED, _BY_TYPE)} AS n,"
    f" {_first_number(_CLEAN, chr(92) + 'd+', _BY_TYPE)} AS y, " + ", ".join(f"{_first_number('ref', _YEARED, [kind])} AS p{i}" for i, kind in enumerate(_BY_TYPE[3:])) + " FROM refs",
    ranged="SELECT a.ref, a.title, a.ref_year, r.year, r.id FROM asked a JOIN reg r ON a.y = r.t || ' ' || r.number AND r.year BETWEEN a.upto - 29 AND a.upto"
    " QUALIFY row_number() OVER (PARTITION BY a.ref, a.title, a.ref_year ORDER BY r.year DESC) = 1",
    answers=f"SELECT a.ref, a.title, a.ref_year, coalesce(x.v, b.v, a.word, c.v, g.id, p.v, d.v, e.v) AS boe_id, CASE WHEN x.v IS NOT NULL THEN 'name' WHEN coalesce(b.v, a.word) IS NOT NULL THEN 'title'"
    " WHEN c.v IS NOT NULL THEN 'number' WHEN g.id IS NOT NULL THEN 'year' WHEN coalesce(p.v, d.v, e.v) IS NOT NULL THEN 'pattern' END AS found_by,"
    f" CASE WHEN coalesce(x.v, b.v, a.word, c.v) IS NULL THEN g.year END AS found_year FROM asked a LEFT JOIN {s.mapping(dims.registry_entries())} x ON lower(trim(a.ref)) = x.k"
    " LEFT JOIN known b ON a.t = b.k LEFT JOIN known c ON a.n = c.k LEFT JOIN ranged g ON a.ref = g.ref AND a.title IS NOT DISTINCT FROM g.title AND a.ref_year IS NOT DISTINCT FROM g.ref_year"
    " LEFT JOIN known p ON a.p0 = p.k LEFT JOIN known d ON a.p1 = d.k LEFT JOIN known e ON a.p2 = e.k",
) + (
    "SELECT r.*, a.boe_id, a.found_by, a.found_year FROM refs r JOIN answers a ON r.ref = a.ref AND r.title IS NOT DISTINCT FROM a.title AND r.ref_year IS NOT DISTINCT FROM a.ref_year"
)
ORACLE["article_format_valid"] = ctes(m=s.LAW_MENTIONS) + (
    "SELECT mention_id, article, regexp_matches(article, '^\\d+(?:\\.\\d+)?(?:\\.[a-z])?$') AS valid FROM m"
)

_TYPED = (
    "SELECT *, CASE WHEN regexp_matches(lower(block_id), '^a\\d+') THEN 'articulo' WHEN regexp_matches(lower(block_id), '^t(?:preliminar|[ivxlcdm]+)$') THEN 'titulo'"
    " WHEN regexp_matches(lower(block_id), '^l[ivxlcdm]+$') THEN 'libro' WHEN regexp_matches(lower(block_id), '^c[ivxlcdm]+$') THEN 'capitulo'"
    " WHEN regexp_matches(lower(block_id), '^s[ivxlcdm]+$') THEN 'seccion' ELSE 'otro' END AS block_type FROM blocks"
)
_PLACED = (
    "SELECT boe_id, pos, block_id, block_title, block_type, last_value(CASE WHEN block_type = 'titulo' THEN pos END IGNORE NULLS) OVER w AS title_pos,"
    " last_value(CASE WHEN block_type = 'titulo' THEN block_title END IGNORE NULLS) OVER w AS title FROM typed WINDOW w AS (PARTITION BY boe_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
_FLAT = (
    "SELECT boe_id, pos, block_id, coalesce(nullif(regexp_extract(block_title, '[Aa]rt[íi]culo\\s+(\\d+(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(block_id, 'a(\\d+)', 1), '')) AS number,"
    " block_title AS name, title_pos, title FROM placed WHERE block_type = 'articulo'"
)
_LAW = dict(blocks=s.BLOCKS, typed=_TYPED, placed=_PLACED, flat=_FLAT)


def _checked(mentions: str, articles: str) -> str:
    return (
        "SELECT m.*, CASE WHEN article IS NOT NULL AND boe_id IN (SELECT boe_id FROM {a}) THEN (boe_id, article_checked) IN (SELECT boe_id, number FROM {a})"
        " OR (boe_id, split_part(article_checked, '.', 1)) IN (SELECT boe_id, number FROM {a}) END AS article_exists FROM"
        " (SELECT *, regexp_replace(" + s.normal_article("article") + ", '^0+', '') AS article_checked FROM {m}) m"
    ).format(a=articles, m=mentions)


ORACLE["validate_articles"] = ctes(m0=s.LAW_MENTIONS, **_LAW) + _checked("m0", "flat")
ORACLE["hallucinated_articles"] = ctes(m0=s.LAW_MENTIONS, **_LAW) + (
    f"SELECT mention_id, boe_id, article FROM ({_checked('m0', 'flat')}) WHERE NOT article_exists"
)
ORACLE["validate_mentions"] = _facts(
    "SELECT doc_id, mention_id, ref, boe_id, article, article_exists, CASE WHEN article IS NOT NULL THEN regexp_matches(article, '^\\d+(?:\\.\\d+)?(?:\\.[a-z])?$') END AS article_valid,"
    " ref IS NOT NULL AND boe_id IS NOT NULL AND coalesce(article_exists, true) AS validated, CASE WHEN ref IS NULL THEN 'No se pudo extraer información de ley'"
    " WHEN boe_id IS NULL THEN 'No se encontró BOE-ID' WHEN NOT article_exists THEN 'Artículo ' || article || ' NO existe en el BOE oficial' END AS reason,"
    f" {q(dims.REGISTRY_URL)} || boe_id AS boe_url FROM ({_checked('ids', 'known')})",
    base="SELECT doc_id, mention_id, text, law, article FROM facts", normed=s.normalized("base"), info=s.law_info("normed"),
    refs="SELECT *, CAST(NULL AS VARCHAR) AS title FROM info", ids=s.registry_ids("refs"), known=fx.sql("part", fx.REGISTRY_ARTICLES),
)
ORACLE["validation_stats"] = _facts(
    "SELECT agent, count(*) AS total, count(*) FILTER (validated) AS validated, count(*) FILTER (NOT validated) AS not_validated, round(count(*) FILTER (validated) / count(*), 6) AS rate,"
    " count(*) FILTER (coalesce(boe_id <> '', false)) AS with_id, count(*) FILTER (coalesce(regexp_matches(article, '^\\d+(?:\\.\\d+)?(?:\\.[a-z])?$'), false)) AS with_valid_article FROM facts GROUP BY agent"
)
ORACLE["article_text_lookup"] = ctes(m0=s.LAW_MENTIONS, blocks=s.BLOCKS, asked=(
    f"SELECT *, split_part(number, '.', 1) AS base FROM (SELECT DISTINCT boe_id, article, {s.normal_article('article')} AS number FROM m0 WHERE article IS NOT NULL)"
), cand=(
    "SELECT boe_id, article, number, 0 AS priority, 'id:a' || base AS key FROM asked UNION ALL SELECT boe_id, article, number, 1, 'id:' || w FROM (SELECT *, CASE WHEN n BETWEEN 0 AND 999 THEN "
    + _WORDS + " END AS w FROM (SELECT *, TRY_CAST(base AS INTEGER) AS n FROM asked))"
    " UNION ALL SELECT boe_id, article, number, 2, 'id:art' || base FROM asked UNION ALL SELECT boe_id, article, number, 3, 'id:a' || base || 'bis' FROM asked"
    " UNION ALL SELECT boe_id, article, number, 4, 'id:art' || base || 'bis' FROM asked UNION ALL SELECT boe_id, article, number, 5, 'id:a' || number FROM asked"
    " UNION ALL SELECT boe_id, article, number, 6, 'no:' || number FROM asked UNION ALL SELECT boe_id, article, number, 7, 'no:' || base FROM asked"
), keys=(
    "SELECT *, 'id:' || block_id AS key FROM blocks UNION ALL SELECT *, 'no:' || regexp_extract(block_title, '(?i)Art(?:[ií]culo|\\.)\\s*(\\d+(?:\\.\\d+)?)\\b', 1) FROM blocks"
    " WHERE regexp_matches(block_title, '(?i)Art(?:[ií]culo|\\.)\\s*(\\d+(?:\\.\\d+)?)\\b')"
), best=(
    "SELECT c.boe_id, c.article, k.block_id, k.block_title, c.priority FROM cand c JOIN keys k ON c.boe_id = k.boe_id AND c.key = k.key"
    " QUALIFY row_number() OVER (PARTITION BY c.boe_id, c.article ORDER BY c.priority, k.pos) = 1"
)) + (
    f"SELECT a.boe_id, a.article, block_id, block_title, priority, CASE WHEN priority IS NOT NULL THEN {q(dims.REGISTRY_URL)} || a.boe_id || '#a' || number END AS url"
    " FROM asked a LEFT JOIN best b ON a.boe_id = b.boe_id AND a.article = b.article"
)
_ACTS = "SELECT DISTINCT * FROM (" + fx.sql("pages", fx.EU_ACTS) + ")"
ORACLE["enrich_eu"] = _docs(
    f"SELECT doc_id, start, text, m.celex, {q(dims.EU_URL)} || 'ES/TXT/?uri=CELEX:' || m.celex AS eu_url, a.celex IS NOT NULL AS act_exists, a.title AS eu_title FROM"
    f" (SELECT *, {s.celex('text')} AS celex FROM ({s.EU_HITS})) m LEFT JOIN acts a ON m.celex = a.celex WHERE m.celex IS NOT NULL",
    acts=_ACTS,
)
_ENRICHED = dict(
    cited=f"SELECT *, split_part(inferred, ',', 1) AS example, {s.celex('text')} AS celex FROM (" + fx.sql("lineitem", fx.ENRICH_MENTIONS) + f") WHERE {s.EXPORTABLE}",
    titles="SELECT boe_id, min(law_title) AS law_title FROM (" + fx.sql("nation", fx.LAW_TITLES) + ") GROUP BY 1",
    texts="SELECT * FROM (" + fx.sql("part", fx.ENRICH_ARTICLES) + ") QUALIFY row_number() OVER (PARTITION BY boe_id, number ORDER BY article_title NULLS FIRST, article_text) = 1",
    acts="SELECT celex, min(title) AS title FROM (" + fx.sql("pages", fx.EU_ACTS) + ") GROUP BY 1",
    eu="SELECT * FROM (" + fx.sql("pages", fx.ENRICH_EU_ARTICLES) + ") QUALIFY row_number() OVER (PARTITION BY celex, number ORDER BY title NULLS FIRST, text) = 1",
    wanted=f"SELECT DISTINCT boe_id, coalesce(article, example) AS article, regexp_replace({s.normal_article('coalesce(article, example)')}, '^0+(\\d)', '\\1') AS n FROM cited"
    " WHERE boe_id IS NOT NULL AND coalesce(article, example) IS NOT NULL",
    answered="SELECT w.boe_id, w.article, coalesce(x.number, b.number, v.number) AS hit, CASE WHEN x.number IS NOT NULL THEN 'exact' WHEN b.number IS NOT NULL THEN 'base' WHEN v.number IS NOT NULL THEN 'word' END AS found_as"
    " FROM wanted w LEFT JOIN texts x ON w.boe_id = x.boe_id AND w.n = x.number LEFT JOIN texts b ON w.boe_id = b.boe_id AND split_part(w.n, '.', 1) = b.number"
    " LEFT JOIN texts v ON w.boe_id = v.boe_id AND split_part(w.n, '.', 1) = '456' AND v.number = 'acuatrocientoscincuentayseis'",
    listed="SELECT celex, article, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS number FROM (SELECT DISTINCT celex, article,"
    " CASE WHEN contains(article, ' y ') OR contains(article, ',') THEN regexp_extract_all(article, '\\d+') ELSE [replace(article, 'art_', '')] END AS l FROM cited WHERE celex IS NOT NULL AND article IS NOT NULL)",
    eu_found="SELECT l.celex, article, string_agg('Art. ' || number || ': ' || coalesce(title, ''), ' | ' ORDER BY pos) AS eu_article_title, string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS eu_article_text"
    " FROM listed l JOIN eu USING (celex, number) GROUP BY 1, 2",
    enriched=f"SELECT doc_id, mention_id, m.text, law, m.article, m.boe_id, l.v AS law_expanded, m.celex, CASE WHEN m.article IS NULL THEN example END AS example_article, law_title, x.article_title, x.article_text,"
    f" f.found_as, a.title AS eu_title, e.eu_article_title, e.eu_article_text, {q(dims.EU_URL)} || 'ES/TXT/?uri=CELEX:' || m.celex AS eu_url, {q(dims.REGISTRY_URL)} || m.boe_id AS boe_url"
    f" FROM cited m LEFT JOIN {s.mapping(dims.LAW_ACRONYMS)} l ON m.law = l.k LEFT JOIN titles t ON m.boe_id = t.boe_id LEFT JOIN answered f ON m.boe_id = f.boe_id AND coalesce(m.article, example) = f.article"
    " LEFT JOIN texts x ON f.boe_id = x.boe_id AND f.hit = x.number LEFT JOIN acts a ON m.celex = a.celex LEFT JOIN eu_found e ON m.celex = e.celex AND m.article = e.article",
)
ORACLE["enrich_mentions"] = ctes(**_ENRICHED) + "SELECT * FROM enriched"
ORACLE["eu_article_batch"] = ctes(wanted=fx.sql("lineitem", fx.EU_WANTED), found=(
    "SELECT DISTINCT " + fx.PAGE_CELEX.format(k="page_id") + " AS celex, unnest([CAST(page_id % 40 + 1 AS VARCHAR), CAST(page_id % 40 + 2 AS VARCHAR)]) AS article FROM pages"
)) + (
    "SELECT w.celex, count(*) AS total, count(f.article) AS ok, count(*) - count(f.article) AS failed FROM wanted w LEFT JOIN found f ON w.celex = f.celex AND replace(w.article, 'art_', '') = f.article GROUP BY w.celex"
)

# -- law corpus ---------------------------------------------------------------------------------------------------

ORACLE["classify_blocks"] = ctes(blocks=s.BLOCKS) + f"SELECT boe_id, pos, block_id, block_type FROM ({_TYPED})"
ORACLE["law_hierarchy"] = ctes(blocks=s.BLOCKS, typed=_TYPED) + _PLACED
ORACLE["law_articles_flat"] = ctes(blocks=s.BLOCKS, typed=_TYPED, placed=_PLACED) + _FLAT
_CONCEPTS = s.values([(c,) for c in fx.CONCEPTS], "concept")
ORACLE["concept_to_articles"] = ctes(**_LAW, concepts=f"SELECT concept FROM {_CONCEPTS}", tops=(
    "SELECT boe_id, concept, min(title_pos) AS title_pos, min_by(title, title_pos) AS found_in FROM flat JOIN concepts ON contains(lower(title), concept) GROUP BY 1, 2"
)) + (
    "SELECT f.boe_id, concept, pos, number, found_in, 'titulo' AS match_type, 90 AS confidence FROM flat f JOIN tops t ON f.boe_id = t.boe_id AND f.title_pos = t.title_pos"
    " UNION ALL SELECT f.boe_id, c.concept, pos, number, 'Artículos relacionados con \"' || c.concept || '\"', 'articulo', 70 FROM flat f JOIN concepts c ON contains(lower(name), c.concept)"
    " WHERE NOT EXISTS (SELECT 1 FROM tops t WHERE t.boe_id = f.boe_id AND t.concept = c.concept)"
)
ORACLE["law_index_stats"] = ctes(**_LAW) + (
    "SELECT boe_id, count(DISTINCT title_pos) AS titles, count(*) AS articles, min_by(number, pos) AS first_article, max_by(number, pos) AS last_article FROM flat GROUP BY boe_id"
)

_NUMBER = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {q('(?i)' + p)}, 1), '')" for p in dims.ARTICLE_PATTERNS) + ")"
_PAGE_LAW = dict(
    src=s.pages(fx.PLANTED_LAW), seg=s.segments("src"),
    blk=f"SELECT *, {_NUMBER} AS number, regexp_matches(attrs, '(?i)class=[\"''][^\"'']*(?:articulo|art\\b)') AS classed FROM seg WHERE tag IN ('h3', 'h4', 'h5', 'p', 'li', 'div')",
    num="SELECT *, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS stop, bool_or(classed) OVER (PARTITION BY page_id) AS any_class FROM blk WHERE number IS NOT NULL",
    heads="SELECT * FROM num WHERE CASE WHEN any_class THEN classed ELSE tag <> 'li' END",
)
_TITLE = "nullif(trim(regexp_extract(h.text, '(?i)(?:Artículo|Art\\.?)\\s+\\d+(?:\\.\\d+)?(?:\\.[a-z])?\\s*\\.\\s*(.+?)(?:\\.|$)', 1)), '')"


def _arts(order: str) -> str:
    return (
        f"SELECT h.page_id, h.pos, h.number, {_TITLE} AS title, h.text || coalesce(' ' || string_agg(b.text, ' ' ORDER BY b.pos) FILTER (b.text <> ''), '') AS body,"
        " coalesce(list(b.text ORDER BY b.pos) FILTER (regexp_matches(b.text, '^\\s*(?:\\d+\\.|[a-z]\\))\\s+\\S')), []) AS items FROM"
        f" (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY page_id, number ORDER BY pos {order}) = 1) h"
        " LEFT JOIN blk b ON b.page_id = h.page_id AND b.pos > h.pos AND (h.stop IS NULL OR b.pos < h.stop) GROUP BY h.page_id, h.pos, h.number, h.text"
    )


_PAGE_ARTS = ctes(**_PAGE_LAW, arts=_arts("ASC"))
ORACLE["html_articles"] = _PAGE_ARTS + "SELECT page_id, number, body FROM arts"
ORACLE["html_articles_last"] = ctes(**_PAGE_LAW, arts=_arts("DESC")) + "SELECT page_id, number, body FROM arts"
ORACLE["article_titles"] = _PAGE_ARTS + "SELECT page_id, number, title FROM arts"
ORACLE["article_paragraphs"] = _PAGE_ARTS + (
    "SELECT page_id, number, CAST(i - 1 AS INTEGER) AS n, items[i] AS item FROM arts, unnest(range(1, len(items) + 1)) AS u(i)"
)
ORACLE["article_prefix_lookup"] = _PAGE_ARTS + (
    "SELECT page_id, wanted, min_by(number, pos) AS number, min_by(body, pos) AS body FROM (SELECT *, CAST(page_id % 40 + 2 AS VARCHAR) AS wanted FROM arts)"
    " WHERE number = wanted OR starts_with(number, wanted || '.') GROUP BY 1, 2"
)
ORACLE["search_articles"] = _PAGE_ARTS + "SELECT page_id, number, body FROM arts WHERE regexp_matches(body, '(?i)objeto\\s+de|ÁMBITO')"
ORACLE["article_stats"] = _PAGE_ARTS + (
    "SELECT page_id, count(*) AS articles, count(title) AS with_title, count(*) FILTER (len(items) > 0) AS with_paragraphs, round(avg(length(body)), 6) AS mean_length FROM arts GROUP BY page_id"
)
ORACLE["law_metadata"] = ctes(src=s.pages(fx.PLANTED_LAW), seg=s.segments("src")) + (
    "SELECT page_id, coalesce(min_by(text, pos) FILTER (tag = 'h2' AND attrs LIKE '%titulo_parrafo%'), min_by(text, pos) FILTER (tag = 'h1')) AS title,"
    " max_by(text, pos) FILTER (tag = 'p' AND attrs LIKE '%\"fecha\"%' AND lower(text) LIKE '%publicaci%') AS published,"
    " max_by(text, pos) FILTER (tag = 'p' AND attrs LIKE '%\"fecha\"%' AND lower(text) LIKE '%vigencia%') AS in_force FROM seg GROUP BY page_id"
)
ORACLE["eu_articles"] = ctes(src=s.pages(fx.PLANTED_EU), seg=s.segments("src"), divs=(
    "SELECT *, sum(CASE WHEN regexp_matches(attrs, '^<div id=\"art_\\d+\"') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS art FROM seg"
), arts=(
    "SELECT page_id, art, max(regexp_extract(attrs, '^<div id=\"art_(\\d+)\"', 1)) AS article, coalesce(min_by(text, pos) FILTER (attrs LIKE '%eli-title%'), '') AS title,"
    " coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (text <> ''), '') AS text,"
    " coalesce(list(text ORDER BY pos) FILTER (text <> '' AND regexp_matches(attrs, '\\sid=') AND NOT regexp_matches(attrs, '\\sclass=') AND NOT regexp_matches(attrs, 'id=\"art_')), []) AS items"
    " FROM divs WHERE art > 0 AND tag = 'div' GROUP BY 1, 2"
)) + (
    "SELECT page_id, article, title, text, array_to_string(items, ' | ') AS items, CAST(len(items) AS INTEGER) AS n_items, CAST(length(text) AS INTEGER) AS n FROM arts"
)
ORACLE["eu_act_title"] = _SEGS + (
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN h ELSE 'Acto' || CASE page_id % 3 WHEN 1 THEN ' ' ELSE '' END || url END AS title FROM pages LEFT JOIN"
    " (SELECT page_id, min_by(text, pos) AS h FROM seg WHERE tag = 'h1' GROUP BY 1) USING (page_id)"
)

# -- consensus --------------------------------------------------------------------------------------------------------

_K = dict(keyed=s.KEYED)
_UNIQUE = (
    "SELECT doc_id, any_agent AS agent, count(*) AS unique_keys FROM (SELECT doc_id, key, min(agent) AS any_agent FROM keyed GROUP BY 1, 2 HAVING count(DISTINCT agent) = 1) GROUP BY 1, 2"
)
ORACLE["agent_keys"] = _facts("SELECT DISTINCT doc_id, agent, key FROM keyed", **_K)
ORACLE["consensus"] = _facts(s.LEVELS, **_K)
ORACLE["unique_by_agent"] = _facts(_UNIQUE, **_K)
ORACLE["agreement_metrics"] = _facts(
    "SELECT doc_id, distinct_keys, round(100.0::DOUBLE * (total_consensus + partial_consensus) / distinct_keys, 6) AS agreement, "
    + ", ".join(
        f"CASE WHEN total_consensus > 0 AND has_{a} THEN 100.0::DOUBLE * common_{a} / total_consensus END AS coverage_{a}" for a in "abc"
    )
    + " FROM levels JOIN (SELECT doc_id, " + ", ".join(
        f"bool_or(agent = '{a.upper()}') AS has_{a}, count(DISTINCT CASE WHEN agent = '{a.upper()}' AND n = present THEN key END) AS common_{a}" for a in "abc"
    )
    + " FROM keyed JOIN (SELECT doc_id, key, count(DISTINCT agent) AS n FROM keyed GROUP BY 1, 2) USING (doc_id, key)"
    " JOIN (SELECT doc_id, count(DISTINCT agent) AS present FROM keyed GROUP BY 1) USING (doc_id) GROUP BY doc_id) USING (doc_id)",
    **_K, levels=s.LEVELS,
)
_SET = "SELECT doc_id, key FROM keyed WHERE agent = '{}'"
ORACLE["agents_union"] = _facts(" UNION ".join(_SET.format(a) for a in "ABC"), **_K)
ORACLE["agents_intersect"] = _facts(f"{_SET.format('A')} INTERSECT {_SET.format('B')}", **_K)
ORACLE["agents_except"] = _facts(f"{_SET.format('A')} EXCEPT (SELECT doc_id, key FROM keyed WHERE agent <> 'A')", **_K)
ORACLE["agreement_matrix"] = _facts(
    "SELECT l.agent AS left, r.agent AS right, CAST(count(*) FILTER (l.has AND r.has) AS BIGINT) AS shared, CAST(count(*) FILTER (l.has OR r.has) AS BIGINT) AS united,"
    " round(count(*) FILTER (l.has AND r.has) / count(*) FILTER (l.has OR r.has), 6) AS jaccard FROM present l JOIN present r ON l.doc_id = r.doc_id AND l.key = r.key GROUP BY 1, 2",
    **_K, present="SELECT doc_id, key, a AS agent, list_contains(agents, a) AS has FROM (SELECT doc_id, key, list(DISTINCT agent) AS agents FROM keyed GROUP BY 1, 2), (SELECT unnest(['A', 'B', 'C']) AS a)",
)
ORACLE["consensus_report"] = _facts(
    "SELECT doc_id, concat_ws(chr(10), repeat('=', 60), '📊 INFORME DE COMPARACIÓN DE AGENTES', repeat('=', 60), chr(10) || '🤖 Agentes analizados: ' || agents_present,"
    " chr(10) || '📋 Referencias por agente:', sizes, chr(10) || '✅ Consenso Total: ' || total_consensus || ' referencias', '⚠️  Consenso Parcial: ' || partial_consensus || ' referencias',"
    " chr(10) || '🎯 Únicas por agente:', uniques, chr(10) || '📊 Métricas:', '   - Total referencias únicas: ' || distinct_keys,"
    " '   - Acuerdo promedio: ' || CAST(round(100.0::DOUBLE * (total_consensus + partial_consensus) / distinct_keys, 1) AS VARCHAR) || '%', chr(10) || repeat('=', 60)) AS report FROM levels"
    " JOIN (SELECT doc_id, string_agg('   - ' || agent || ': ' || n || ' referencias', chr(10) ORDER BY agent) AS sizes FROM (SELECT doc_id, agent, count(*) AS n FROM keyed GROUP BY 1, 2) GROUP BY 1) USING (doc_id)"
    " LEFT JOIN (SELECT doc_id, string_agg('   - ' || agent || ': ' || unique_keys || ' únicas', chr(10) ORDER BY agent) AS uniques FROM uniq GROUP BY 1) USING (doc_id)",
    **_K, levels=s.LEVELS, uniq=_UNIQUE,
)

# -- audit --------------------------------------------------------------------------------------------------------------

_P = dict(profile=s.PROFILE)
_X = "round(100.0::DOUBLE * {} / total, 6)"
ORACLE["audit_confidence"] = _facts(
    f"SELECT doc_id, total, mean_confidence, min_confidence, max_confidence, high, medium, low, {_X.format('high')} AS high_pct, {_X.format('medium')} AS medium_pct, {_X.format('low')} AS low_pct FROM profile", **_P
)
ORACLE["audit_validation"] = _facts(
    f"SELECT doc_id, validated, not_validated, rate, {_X.format('validated')} AS validated_pct, ids_found FROM profile", **_P
)
ORACLE["audit_coverage"] = _facts(
    "SELECT doc_id, laws, articles, CASE WHEN articles > 0 THEN round(laws / articles, 6) ELSE 'Infinity'::DOUBLE END AS law_article_ratio FROM profile", **_P
)
ORACLE["coverage_cube"] = _facts(
    "SELECT doc_id, kind, agent, count(*) AS mentions FROM facts GROUP BY GROUPING SETS ((doc_id, kind), (doc_id, agent), (doc_id))"
)
_CONVERGED = "SELECT doc_id, max_by(converged, round) AS converged, max(round) AS rounds FROM history GROUP BY doc_id"
ORACLE["audit_problems"] = _facts(
    f"SELECT doc_id, severity, problem, description, action FROM ({s.problem_rows('converged')})",
    history=_HISTORY, conv=_CONVERGED, base=s.PROFILE, profile="SELECT * FROM base LEFT JOIN conv USING (doc_id)",
)
ORACLE["audit_suggestions"] = _facts(s.suggestion_rows(), **_P)
ORACLE["audit_grade"] = _facts(
    f"SELECT doc_id, grade, level, emoji, confidence_factor, validation_factor, coverage_factor FROM ({s.GRADED})", **_P
)
_V = "CAST({} AS VARCHAR)"
_R1 = "CAST(round(100.0::DOUBLE * {} / total, 1) AS VARCHAR)"
_AUDIT_TEXT = (
    "SELECT doc_id, concat_ws(chr(10), repeat('=', 80), '📊 INFORME DE AUDITORÍA DE REFERENCIAS LEGALES', repeat('=', 80),"
    " chr(10) || emoji || ' CALIFICACIÓN GLOBAL: ' || CAST(grade AS VARCHAR) || '/10 - ' || level, chr(10) || '📊 Factores:', '   - Confianza: ' || CAST(confidence_factor AS VARCHAR) || '/10',"
    " '   - Validación: ' || CAST(validation_factor AS VARCHAR) || '/10', '   - Cobertura: ' || CAST(coverage_factor AS VARCHAR) || '/10', chr(10) || '📋 Resumen:', '   - Total referencias: ' || total,"
    " chr(10) || '🎯 Confianza:', '   - Promedio: ' || CAST(round(mean_confidence, 1) AS VARCHAR) || '%',"
    f" '   - Alta (≥90%): ' || high || ' (' || {_R1.format('high')} || '%)', '   - Media (70-89%): ' || medium || ' (' || {_R1.format('medium')} || '%)', '   - Baja (<70%): ' || low || ' (' || {_R1.format('low')} || '%)',"
    f" chr(10) || '✅ Validación:', '   - Validadas: ' || validated || '/' || total || ' (' || {_R1.format('validated')} || '%)', '   - BOE-IDs encontrados: ' || ids_found,"
    " chr(10) || '📈 Cobertura:', '   - Tipos encontrados: ' || array_to_string(kinds, ', '), '   - Leyes: ' || laws, '   - Artículos: ' || articles, probs, sugg, review, chr(10) || repeat('=', 80)) AS report"
    " FROM graded LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)"
)
_AUDIT_PARTS = dict(
    **_P, graded=s.GRADED,
    pr=f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM ({s.problem_rows(None)})",
    p="SELECT doc_id, chr(10) || '⚠️  Problemas Detectados: ' || count(*) || chr(10) || string_agg(chr(10) || '   ' || i || '. [' || upper(severity) || '] ' || problem || chr(10) || '      ' || description || chr(10) || '      → ' || action, chr(10) ORDER BY i) AS probs FROM pr GROUP BY doc_id",
    g=f"SELECT doc_id, chr(10) || '💡 Sugerencias:' || chr(10) || '   ' || string_agg(suggestion, chr(10) || '   ' ORDER BY n) AS sugg FROM ({s.suggestion_rows()}) GROUP BY doc_id",
    low="SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, mention_id) AS i FROM facts WHERE coalesce(confidence, 0) < 70",
    r="SELECT doc_id, chr(10) || '🔍 Referencias que Requieren Revisión Manual:' || chr(10) || string_agg(chr(10) || '   ' || i || '. ' || text || ' (confianza: ' || coalesce(confidence, 0) || '%)' || chr(10) || '      Encontrado por: ' || agent, chr(10) ORDER BY i) AS review FROM low WHERE i <= 10 GROUP BY doc_id",
)
ORACLE["audit_report"] = _facts(_AUDIT_TEXT, **_AUDIT_PARTS)
ORACLE["audit_review"] = _facts(
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, mention_id) AS seq, mention_id, text, coalesce(confidence, 0) AS confidence, agent FROM facts WHERE coalesce(confidence, 0) < 70"
)
ORACLE["corpus_summary"] = _facts(
    "SELECT doc_id, total, validated, rate, rounds, converged, total_consensus, partial_consensus, round(100.0::DOUBLE * (total_consensus + partial_consensus) / distinct_keys, 6) AS agreement, grade, level"
    " FROM graded JOIN levels USING (doc_id) JOIN conv USING (doc_id)",
    **_P, graded=s.GRADED, **_K, levels=s.LEVELS, history=_HISTORY, conv=_CONVERGED,
)

# -- inference -------------------------------------------------------------------------------------------------------------

_CDOCS = fx.sql("documents", fx.CONCEPT_DOCUMENTS)
_NAMED = s.values([(c,) for c in fx.CONCEPT_NAMES], "concept")
_FOUND = f"SELECT doc_id, concept FROM cdocs JOIN {_NAMED} ON contains(lower(text), concept)"
_CMAP = fx.CONCEPT_MAP.format(part="part")
_CITED_PAIRS = fx.sql("lineitem", fx.CONCEPT_CITED)
ORACLE["detect_concepts"] = ctes(cdocs=_CDOCS, found=_FOUND, cmap=_CMAP, cited=_CITED_PAIRS) + (
    "SELECT doc_id, concept FROM found f WHERE NOT EXISTS (SELECT 1 FROM cited c JOIN cmap m ON c.boe_id = m.boe_id WHERE c.doc_id = f.doc_id AND m.concept = f.concept)"
)
_SPREAD = (
    "SELECT concept, doc_id, law, boe_id, confidence, CAST(a AS VARCHAR) AS article FROM found JOIN (SELECT *, unnest(range(TRY_CAST(first_article AS BIGINT), CAST(last_article AS BIGINT) + 1)) AS a"
    " FROM cmap WHERE confidence >= 70 AND TRY_CAST(first_article AS BIGINT) IS NOT NULL) USING (concept)"
)
_RANGES = dict(cdocs=_CDOCS, found=_FOUND, cmap=_CMAP, spread=_SPREAD)
ORACLE["concept_ranges"] = ctes(**_RANGES) + "SELECT * FROM spread"
_VALID = dict(
    real="SELECT DISTINCT * FROM (" + fx.sql("part", fx.CONCEPT_ARTICLES) + ")",
    pairs="SELECT DISTINCT concept, boe_id, article FROM spread",
    good="SELECT concept, p.boe_id FROM pairs p LEFT JOIN real r ON p.boe_id = r.boe_id AND p.article = r.number GROUP BY 1, 2 HAVING count(r.number) > 0 AND count(r.number) / count(*) >= 0.5",
    valid="SELECT s.* FROM spread s JOIN good USING (concept, boe_id) JOIN real r ON s.boe_id = r.boe_id AND s.article = r.number",
)
ORACLE["validate_ranges"] = ctes(**_RANGES, **_VALID) + "SELECT * FROM valid"
ORACLE["inferred_new_only"] = ctes(**_RANGES, **_VALID, cited=f"SELECT DISTINCT * FROM ({_CITED_PAIRS})", marked=(
    "SELECT v.*, c.doc_id IS NOT NULL AS old FROM valid v LEFT JOIN cited c ON v.doc_id = c.doc_id AND v.boe_id = c.boe_id AND v.article = c.article"
)) + (
    "SELECT * EXCLUDE (old, olds, n) FROM (SELECT *, count(*) FILTER (old) OVER (PARTITION BY doc_id, concept, boe_id) AS olds, count(*) OVER (PARTITION BY doc_id, concept, boe_id) AS n FROM marked)"
    " WHERE NOT old AND n - olds >= 0.5 * n"
)
_STRUCT = "CASE WHEN contains(translate(lower(kind), 'íáéóú', 'iaeou'), 'capitulo') THEN '{c}' || chr(10) || chr(10) WHEN contains(translate(lower(kind), 'íáéóú', 'iaeou'), 'titulo') THEN '{t}' || chr(10) || chr(10) ELSE '' END"
_ART_TEXT = "trim(regexp_replace(regexp_replace(coalesce(eu_article_text, article_text), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
_ENRICHED_ROWS = dict(_ENRICHED, verified="SELECT e.*, m.kind, m.start FROM enriched e JOIN cited m USING (mention_id, doc_id)", numbered=(
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS seq FROM verified"
))
ORACLE["report_markdown_enriched"] = ctes(**_ENRICHED_ROWS) + (
    f"{_MD_HEAD} FROM (SELECT doc_id, count(*) AS verified, 0 AS inferred FROM verified GROUP BY doc_id) UNION ALL"
    " SELECT doc_id, 1 AS section, seq, '## ' || seq || '. ' || text || chr(10) || chr(10) || coalesce('**' || coalesce(law_title, law_expanded) || '**' || chr(10) || chr(10), '')"
    f" || {_STRUCT.format(c='**Tipo:** Capítulo', t='**Tipo:** Título de código')}"
    " || coalesce('**BOE-ID:** ' || boe_id || chr(10) || '**BOE URL:** [' || boe_url || '](' || boe_url || ')' || chr(10) || chr(10), '')"
    " || CASE WHEN eu_url IS NOT NULL THEN '**CELEX:** ' || celex || chr(10) || '**EUR-Lex:** [' || eu_url || '](' || eu_url || ')' || chr(10) || coalesce('**Título:** ' || eu_title || chr(10), '') || chr(10) ELSE '' END"
    f" || CASE WHEN coalesce(eu_article_text, article_text) IS NOT NULL THEN '### Texto del Artículo' || chr(10) || chr(10) || coalesce('**' || coalesce(eu_article_title, article_title) || '**' || chr(10) || chr(10), '') || {_ART_TEXT} || chr(10) || chr(10) ELSE '' END"
    " || '---' || chr(10) AS block FROM numbered"
)
_NORMS = dict(facts=s.FACTS, **_RANGES, **_VALID, norms=(
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, concept, boe_id) AS seq FROM (SELECT doc_id, concept, law, boe_id, confidence,"
    " string_agg(article, ', ' ORDER BY i) FILTER (i <= 20) || CASE WHEN count(*) > 20 THEN '...' ELSE '' END AS articles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, concept, boe_id"
    " ORDER BY CAST(article AS INTEGER), article) AS i FROM valid) GROUP BY 1, 2, 3, 4, 5)"
))
_COUNTS = (
    "SELECT doc_id, CAST(coalesce(v, 0) AS BIGINT) AS verified, CAST(coalesce(i, 0) AS BIGINT) AS inferred FROM (SELECT doc_id, count(*) AS v FROM verified GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS i FROM norms GROUP BY 1) USING (doc_id)"
)
ORACLE["report_markdown_inferred"] = ctes(
    **_NORMS, verified=f"SELECT * FROM facts WHERE {s.EXPORTABLE} AND doc_id IN (SELECT doc_id FROM norms)", numbered=_NUMBERED, counts=_COUNTS,
) + (
    f"{_MD_HEAD} FROM counts UNION ALL {_MD_BODY} UNION ALL SELECT doc_id, 3, seq, '## BETA-' || seq || '. ' || law || chr(10) || chr(10) || '**Concepto detectado:** ' || concept || chr(10)"
    " || '**Confianza IA:** ' || confidence || '%' || chr(10) || '**Artículos sugeridos:** ' || articles || chr(10) || chr(10) || '**BOE-ID:** ' || boe_id || chr(10)"
    f" || '**BOE URL:** [' || {q(dims.REGISTRY_URL)} || boe_id || '](' || {q(dims.REGISTRY_URL)} || boe_id || ')' || chr(10) || chr(10) || '---' || chr(10) FROM norms"
    " UNION ALL SELECT DISTINCT doc_id, 2, 0, chr(10) || '# 🧠 SECCIÓN 2: POSIBLES NORMAS INFERIDAS (BETA)' || chr(10) || chr(10)"
    " || '⚠️ **IMPORTANTE:** Estas referencias han sido sugeridas por IA basándose en conceptos legales detectados en el texto.' || chr(10) || chr(10)"
    " || '**No fueron mencionadas explícitamente** en el material de estudio, pero pueden ser relevantes para el tema.' || chr(10) || chr(10)"
    " || '✅ **Recomendación:** Verifica estas referencias con tu material de estudio antes de incluirlas.' || chr(10) || chr(10) || '---' || chr(10) FROM norms"
)
_NL = "chr(10)"
_THIN = "repeat('-', 80)"


def _say(*lines: str) -> str:
    """SQL text of lines joined by line ends; a line that is no SQL expression is quoted."""
    return f" || {_NL} || ".join(lines)


ORACLE["report_text_inferred"] = ctes(**_NORMS, **_ENRICHED_ROWS, counts=_COUNTS) + (
    "SELECT doc_id, 0 AS section, CAST(0 AS BIGINT) AS seq, "
    + _say(_TXT, "'REFERENCIAS LEGALES EXTRAÍDAS'", _TXT, "''", "'Tema: ' || doc_id", "'Fecha: 01/01/2024 00:00'", "'Total referencias verificadas: ' || verified")
    + f" || {_NL} || CASE WHEN inferred > 0 THEN 'Total referencias inferidas (BETA): ' || inferred || {_NL} ELSE '' END || "
    + _say("''", _TXT, "''", "'SECCIÓN 1: REFERENCIAS VERIFICADAS'", "''", "'Estas referencias han sido extraídas directamente del texto y validadas'", "'contra el BOE oficial.'", "''", _TXT, "''")
    + f" AS block FROM counts UNION ALL SELECT doc_id, 9, 0, {_TXT} FROM counts UNION ALL SELECT doc_id, 1, seq, "
    + _say(_THIN, "seq || '. ' || text", _THIN, "''", "coalesce('LEY: ' || coalesce(law_title, law_expanded) || chr(10) || chr(10), '')")
    + f" || {_STRUCT.format(c='TIPO: Capítulo', t='TIPO: Título de código')} || coalesce('BOE-ID: ' || boe_id || chr(10) || 'BOE URL: ' || boe_url || chr(10) || chr(10), '')"
    " || CASE WHEN eu_url IS NOT NULL THEN 'CELEX: ' || celex || chr(10) || 'EUR-Lex URL: ' || eu_url || chr(10) || coalesce('Título EUR-Lex: ' || eu_title || chr(10), '') || chr(10) ELSE '' END"
    " || CASE WHEN article IS NOT NULL AND coalesce(eu_article_text, article_text) IS NOT NULL THEN 'TEXTO DEL ARTÍCULO:' || chr(10) || chr(10)"
    f" || coalesce(coalesce(eu_article_title, article_title) || chr(10) || chr(10), '') || {_ART_TEXT} || chr(10) || chr(10) ELSE '' END FROM numbered"
    " UNION ALL SELECT DISTINCT doc_id, 2, 0, "
    + _say("''", _TXT, "'SECCIÓN 2: POSIBLES NORMAS INFERIDAS (BETA)'", _TXT, "''", "'IMPORTANTE: Estas referencias han sido sugeridas por IA basándose en'", "'conceptos legales detectados en el texto.'", "''",
           "'No fueron mencionadas explícitamente en el material de estudio, pero'", "'pueden ser relevantes para el tema.'", "''", "'RECOMENDACIÓN: Verifica estas referencias con tu material de estudio'", "'antes de incluirlas.'", "''", _TXT, "''")
    + " FROM norms UNION ALL SELECT doc_id, 3, seq, "
    + _say(_THIN, "'BETA-' || seq || '. ' || law", _THIN, "''", "'Concepto detectado: ' || concept", "'Confianza IA: ' || confidence || '%'", "'Artículos sugeridos: ' || articles", "''",
           "'BOE-ID: ' || boe_id", f"'BOE URL: ' || {q(dims.REGISTRY_URL)} || boe_id", "''", "''")
    + " FROM norms"
)

# -- streaming ----------------------------------------------------------------------------------------------------------------

ORACLE["stream_extract"] = ORACLE["extract_all_profiles"]
_REQ = fx.sql("events", fx.REQUEST_LOG_SQL)
ORACLE["rate_window_count"] = ctes(req=_REQ) + (
    "SELECT *, in_span > 10 AS over_limit FROM (SELECT *, count(*) OVER (PARTITION BY client ORDER BY t_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_span FROM req)"
)
ORACLE["rate_admission"] = (
    f"WITH RECURSIVE req AS ({_REQ}), items AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t_us, event_id) AS rn FROM req),"
    " walk AS (SELECT DISTINCT client, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS t_us, CAST(0 AS BIGINT) AS rn, []::BIGINT[] AS held, false AS admitted FROM req"
    " UNION ALL SELECT i.client, i.event_id, i.t_us, i.rn, CASE WHEN len(list_filter(w.held, lambda h: h > i.t_us - 60000000)) < 10"
    " THEN list_append(list_filter(w.held, lambda h: h > i.t_us - 60000000), i.t_us) ELSE list_filter(w.held, lambda h: h > i.t_us - 60000000) END,"
    " len(list_filter(w.held, lambda h: h > i.t_us - 60000000)) < 10 FROM walk w JOIN items i ON i.client = w.client AND i.rn = w.rn + 1)"
    " SELECT client, event_id, t_us, admitted FROM walk WHERE rn > 0"
)
_LOG = fx.sql("events", fx.JOB_LOG)
_WINDOWS = (
    "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, status, count(*) AS events, round(avg(progress), 6) AS mean_progress FROM log GROUP BY ALL"
)
ORACLE["job_windows"] = ctes(log=_LOG) + _WINDOWS
ORACLE["stream_job_windows"] = ctes(log=_LOG) + (
    f"SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT max(ts) FROM log) - INTERVAL 10 MINUTES"
)
_SESSIONS = (
    "SELECT *, date_diff('microsecond', started_at, finished_at) // 1000000 AS seconds FROM (SELECT job_id, min(ts) AS created_at, min(ts) FILTER (status = 'running') AS started_at,"
    " max(ts) FILTER (status IN ('completed', 'failed', 'cancelled')) AS finished_at, count(*) AS events FROM log GROUP BY job_id)"
)
_JOBS = (
    "SELECT job_id, created_at, ts, event_id, status, progress FROM (SELECT *, min(ts) OVER (PARTITION BY job_id) AS created_at FROM log)"
    " QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1"
)
ORACLE["job_sessions"] = ctes(log=_LOG) + _SESSIONS
ORACLE["job_latest"] = ctes(log=_LOG) + _JOBS
ORACLE["job_retention"] = ctes(log=_LOG) + (
    f"SELECT job_id, status, created_at FROM ({_JOBS}) WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '{fx.AS_OF}' - INTERVAL 24 HOURS)"
)
ORACLE["job_stats"] = ctes(log=_LOG) + (
    "SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,"
    " count(*) FILTER (status IN ('pending', 'running')) AS active, round(count(*) FILTER (status = 'completed') / count(*), 6) AS success_rate,"
    " round(coalesce(avg(seconds) FILTER (status = 'completed'), 0), 6) AS mean_seconds, CAST(coalesce(sum(floor(progress)) FILTER (status = 'completed'), 0) AS BIGINT) AS extracted"
    f" FROM ({_JOBS}) JOIN (SELECT job_id, seconds FROM ({_SESSIONS})) USING (job_id)"
)
ORACLE["progress_phase"] = ctes(log=_LOG) + (
    "SELECT event_id, progress, CASE " + " ".join(f"WHEN progress < {b} THEN {q(n)}" for b, n in dims.PROGRESS_PHASES if b is not None)
    + f" ELSE {q(dims.PROGRESS_PHASES[-1][1])} END AS phase FROM log"
)

# -- the whole way ---------------------------------------------------------------------------------------------------------------

ORACLE["top_cited_laws"] = _docs(
    f"SELECT boe_id, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM ({s.registry_ids('refs')}) WHERE boe_id IS NOT NULL GROUP BY boe_id",
    found=f"SELECT * FROM ({s.mentions()}) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(text)) ORDER BY {s.RANK}, start, mention_id) = 1",
    kept="SELECT * FROM found WHERE coalesce(confidence, 0) >= 70",
    normed=s.normalized("kept"), info=s.law_info("normed"), refs="SELECT *, CAST(NULL AS VARCHAR) AS title FROM info",
)

# -- the whole way ------------------------------------------------------------------------------------------------------------

_NOISE = "regexp_matches(text, '\\bST[CS]\\b') OR regexp_matches(text, '(?i)^\\s*(?:la|el)\\s+(?:ley|norma|código|reglamento)\\s*$')"
_LAW_PART = "CASE WHEN coalesce(boe_id, '') <> '' THEN 'BOE:' || boe_id ELSE replace(trim(lower(coalesce(celex, law_norm, law, ''))), ' ', '') END"
_WHOLE = dict(
    docs=s.CITED,
    mentions=f"SELECT * FROM ({s.mentions()}) WHERE NOT ({_NOISE})",
    acts=f"SELECT doc_id, start, text AS act FROM ({s.EU_HITS})",
    lawful=f"SELECT doc_id, start, law AS its_law FROM ({_ARTICLE_LAW})",
    placed="SELECT doc_id, mention_id, agent, kind, CASE WHEN kind = 'articulo' AND act IS NOT NULL THEN act ELSE text END AS text,"
    " CASE WHEN kind = 'articulo' AND act IS NULL THEN coalesce(law, its_law) ELSE law END AS law, article, confidence, start, kind = 'articulo' AND act IS NOT NULL AS eu"
    " FROM mentions LEFT JOIN acts USING (doc_id, start) LEFT JOIN lawful USING (doc_id, start)"
    " UNION ALL SELECT doc_id, sha256(concat_ws('|', doc_id, 'C', 'reglamento', start, act)), 'C', 'reglamento', act, NULL,"
    " nullif(regexp_extract(act, '(?i)^art(?:ículo|iculo|\\.)?\\s+(\\d+)\\s+del?\\s', 1), ''), 95, start, true FROM acts",
    top=f"SELECT doc_id, law AS top_law FROM (SELECT doc_id, law, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS every FROM"
    f" (SELECT doc_id, coalesce({s.law_form('law')[0]}, {_TF}, law) AS law FROM placed WHERE law IS NOT NULL) GROUP BY 1, 2)"
    " QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, law) = 1 AND n * 100 >= 80 * every",
    found="SELECT * REPLACE (CASE WHEN kind = 'articulo' AND NOT eu THEN coalesce(law, top_law) ELSE law END AS law) FROM placed LEFT JOIN top USING (doc_id)",
    aliased=f"SELECT *, CASE WHEN acr AND celex IS NULL THEN coalesce(al, law) ELSE law END AS law2 FROM (SELECT e.*, a.v AS al, {s.is_acronym('kind', 'text')} AS acr FROM ({_eu_normal('found')}) e"
    f" LEFT JOIN {s.mapping(dims.acronym_laws())} a ON replace(upper(trim(text)), '.', '') = a.k)",
    normed=f"SELECT doc_id, mention_id, agent, kind, text, law2 AS law, article, confidence, start, celex, CASE WHEN celex IS NULL THEN coalesce({_LF}, {_TF}) END AS law_norm FROM aliased",
    info=s.law_info("normed"), refs="SELECT *, CAST(NULL AS VARCHAR) AS title FROM info", ids=s.registry_ids("refs"), known=fx.sql("part", fx.REGISTRY_ARTICLES),
    judged=f"SELECT *, celex IS NOT NULL OR (ref IS NOT NULL AND boe_id IS NOT NULL AND coalesce(article_exists, true)) AS validated, CASE WHEN celex IS NOT NULL THEN NULL"
    " WHEN ref IS NULL THEN 'No se pudo extraer información de ley' WHEN boe_id IS NULL THEN 'No se encontró BOE-ID' WHEN NOT article_exists THEN 'Artículo ' || article || ' NO existe en el BOE oficial' END AS reason,"
    f" {_LAW_PART} AS law_part, nullif({s.normal_article('article')}, '') AS art FROM ({_checked('ids', 'known')})",
    keyed="SELECT doc_id, mention_id, agent, kind, text, law, article, start, confidence, celex, law_norm, boe_id, article_exists, validated, reason,"
    " CASE WHEN art IS NULL THEN law_part ELSE law_part || ':art' || art || CASE WHEN law_part = '' THEN '@' || start ELSE '' END END AS key FROM judged",
    facts=f"SELECT * FROM keyed WHERE coalesce(confidence, 100) >= 70 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY {s.RANK}, start, mention_id) = 1",
)
ORACLE["pipeline_mentions"] = ctes(**_WHOLE) + "SELECT * FROM facts"
ORACLE["pipeline_consensus"] = ctes(**_WHOLE) + s.LEVELS
ORACLE["pipeline_audit"] = ctes(**_WHOLE, **_AUDIT_PARTS) + _AUDIT_TEXT
ORACLE["pipeline_report"] = ctes(
    **_WHOLE, verified=f"SELECT *, {q(dims.EU_URL)} || 'ES/TXT/?uri=CELEX:' || celex AS eu_url, {q(dims.REGISTRY_URL)} || boe_id AS url FROM facts WHERE {s.EXPORTABLE}",
    numbered="SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, mention_id) AS seq FROM verified",
) + (
    f"{_MD_HEAD} FROM (SELECT doc_id, count(*) AS verified, 0 AS inferred FROM verified GROUP BY doc_id) UNION ALL"
    " SELECT doc_id, 1, seq, '## ' || seq || '. ' || text || chr(10) || chr(10) || coalesce('**BOE-ID:** ' || boe_id || chr(10) || '**BOE URL:** [' || url || '](' || url || ')' || chr(10) || chr(10), '')"
    " || coalesce('**CELEX:** ' || celex || chr(10) || '**EUR-Lex:** [' || eu_url || '](' || eu_url || ')' || chr(10) || chr(10), '') || '---' || chr(10) FROM numbered"
)
