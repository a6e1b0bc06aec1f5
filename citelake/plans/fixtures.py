"""Tables derived from the given tables: documents with planted citations, mention facts, law
indexes, planted markup, logs. The given tables hold no citations, so each derivation is one
deterministic projection. The expressions are portable SQL; the checks read the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citelake.sources.tables import read_spread, read_table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = read_spread if name in ("documents", "pages", "lineitem", "orders") else read_table
    return reader(spark, f"{sf_dir}/{name}.parquet")


# -- documents with planted citations ----------------------------------------

_ART = "CAST(doc_id % 60 + 1 AS STRING)"
FORMS = [
    f"'artículo ' || {_ART} || ' de la Constitución Española'",
    f"'art. ' || {_ART} || ' CE'",
    "'Ley 39/2015'",
    f"'artículo ' || {_ART} || '.2.b de la Ley 40/2015'",
    "'Ley Orgánica 6/1985'",
    "'Real Decreto 203/2021'",
    "'RD 203/2021'",
    "'LEC'",
    "'Reglamento (UE) 2016/679'",
    f"'art. ' || {_ART} || ' del RGPD'",
    "'la presente ley'",
    "'Directiva (UE) 2016/680'",
    "'el Código Civil'",
    "'Ley 999/2099'",
]


def _slot(j: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(FORMS))
    return (
        f"CASE WHEN {j} < 1 + doc_id % 5 THEN ' Según ' || CASE (doc_id * 11 + {3 * j}) % 14 {cases} END"
        " || ' se resuelve.' ELSE '' END"
    )


CITED_DOCUMENTS = {
    "doc_id": "doc_id",
    "lang": "lang",
    "source": "source",
    "text": "replace(text, chr(160), ' ') || " + " || ".join(_slot(j) for j in range(5)),
}

# -- mention facts over lineitem ----------------------------------------------

_LAW_NO = "CAST(l_partkey % 26 + 1 AS STRING)"
_TEXT = (
    f"CASE l_linenumber % 3 WHEN 0 THEN 'Ley ' || {_LAW_NO} || '/2015'"
    f" WHEN 1 THEN 'artículo ' || CAST(l_linenumber AS STRING) || ' de la Ley ' || {_LAW_NO} || '/2015'"
    f" ELSE 'L' || {_LAW_NO} END"
)
MENTION_FACTS = {
    "doc_id": "l_orderkey",
    "mention_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'"
    " || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING)",
    "agent": "CASE l_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END",
    "kind": "CASE l_linenumber % 3 WHEN 0 THEN 'ley' WHEN 1 THEN 'articulo' ELSE 'sigla' END",
    "text": f"CASE WHEN l_linestatus = 'O' THEN upper({_TEXT}) || ' ' ELSE {_TEXT} END",
    "law": f"CASE WHEN l_linenumber % 3 = 1 AND l_suppkey % 4 = 0 THEN NULL ELSE 'Ley ' || {_LAW_NO} || '/2015' END",
    "article": "CASE WHEN l_linenumber <= 4 THEN CAST(l_linenumber AS STRING) END",
    "confidence": "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(50 + l_quantity AS INT) END",
    "validated": "l_returnflag <> 'R'",
    "boe_id": f"CASE WHEN l_returnflag <> 'R' THEN 'BOE-A-2015-' || {_LAW_NO} END",
    "round": "l_linenumber % 3 + 1",
    "start": "CAST(l_linenumber AS BIGINT) * 100000000000000 + l_partkey * 1000000 + l_suppkey * 100"
    " + CAST(l_quantity AS BIGINT)",
}

# -- law index over part --------------------------------------------------------

LAW_BLOCKS = {
    "boe_id": "p_brand",
    "pos": "p_partkey",
    "block_id": "CASE WHEN p_size <= 5 THEN 't' || substr('ivxlcdm', CAST(p_size AS INT), 1)"
    " WHEN p_size = 6 THEN 'daprimera' WHEN p_size = 7 THEN 'ci' WHEN p_size = 8 THEN 'li'"
    " WHEN p_size = 9 THEN 'si' WHEN p_size = 10 THEN 'tpreliminar'"
    " ELSE 'a' || CAST(p_partkey % 700 + 1 AS STRING) END",
    "block_title": "CASE WHEN p_size <= 5 OR p_size = 10 THEN 'TÍTULO ' || upper(p_type) || '. Del ' || p_name"
    " WHEN p_size <= 9 THEN upper(p_type)"
    " WHEN p_size <= 14 THEN p_name"
    " ELSE 'Artículo ' || CAST(p_partkey % 700 + 1 AS STRING) || '. ' || p_name END",
}

#: concepts looked for in titles and documents
CONCEPTS = ["widget", "ring", "bolt", "gizmo", "plate", "rod"]

# -- mentions of indexed laws over lineitem ---------------------------------------

LAW_MENTIONS = {
    "mention_id": MENTION_FACTS["mention_id"],
    "doc_id": "l_orderkey",
    "boe_id": "'Brand#' || CAST(l_suppkey % 30 + 1 AS STRING)",
    "article": "CASE l_linenumber WHEN 1 THEN NULL"
    " WHEN 2 THEN '0' || CAST(l_partkey % 800 + 1 AS STRING)"
    " WHEN 3 THEN CAST(l_partkey % 800 + 1 AS STRING) || '.2.b'"
    " WHEN 4 THEN 'Art. ' || CAST(l_partkey % 800 + 1 AS STRING)"
    " WHEN 5 THEN CAST(l_partkey % 800 + 1 AS STRING) || ' bis'"
    " ELSE CAST(l_partkey % 800 + 1 AS STRING) END",
}

# -- acronyms over part -------------------------------------------------------------

ALIAS_ROWS = {
    "alias": "upper(substr(p_name, 1, 1)) || '.' || upper(substr(p_name, instr(p_name, ' ') + 1, 1)) || '.'",
    "meaning": "p_name || ', Ley ' || CAST(length(p_name) AS STRING) || '/2015'",
    "pos": "p_partkey",
}

# -- logs over events ------------------------------------------------------------------

JOB_STATUS = (
    "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed'"
    " WHEN 'error' THEN 'failed' ELSE 'cancelled' END"
)
JOB_LOG = {"job_id": "user_id", "event_id": "event_id", "ts": "ts", "status": JOB_STATUS, "progress": "value"}
LOOKUP_CACHE = {"cache_key": "user_id % 50", "value": "value", "ts": "ts", "event_id": "event_id"}
AS_OF = "2024-01-31 00:00:00"

# -- markup planted into pages --------------------------------------------------------------

_N = "CAST(page_id % 40 + 1 AS STRING)"
_N2 = "CAST(page_id % 40 + 2 AS STRING)"
PLANTED_OUTLINE = (
    f"'<h2>Sección ' || {_N} || '</h2><h3>Parte a</h3><p>Uno &amp; dos.</p><h3>Parte <b>b</b></h3>'"
    f" || '<h2>Sección ' || {_N2} || '</h2><ul><li>primero</li><li>segundo</li></ul>'"
)
PLANTED_LAW = (
    f"'<h2 class=\"titulo_parrafo\">Ley ' || {_N} || '/2015</h2>'"
    f" || '<p class=\"fecha\">Fecha de publicación: 0' || CAST(page_id % 9 + 1 AS STRING) || '/10/2015</p>'"
    " || '<p class=\"fecha\">Entrada en vigencia: 02/10/2016</p>'"
    f" || '<p class=\"articulo\">Artículo ' || {_N} || '. Objeto de la norma.</p><p>1. Primer apartado.</p><p>2. Segundo apartado.</p>'"
    f" || '<ul><li>a) letra a</li><li>b) letra b</li></ul>'"
    f" || '<p class=\"articulo\">Artículo ' || {_N2} || '.1. Ámbito.</p><p>Texto del ámbito.</p>'"
    f" || '<p class=\"articulo\">Artículo ' || {_N} || '. Repetido.</p><p>No cuenta.</p>'"
)
PLANTED_EU = (
    f"'<div id=\"art_' || {_N} || '\"><div class=\"eli-title\">Derecho de <i>supresión</i></div>'"
    f" || '<div id=\"a.1\">1. Primer párrafo.</div><div id=\"a.2\">2. Segundo párrafo.</div><div class=\"x\" id=\"a.3\">nota</div></div>'"
    f" || '<div id=\"art_' || {_N2} || '\"><div class=\"eli-title\">Otro título</div><div id=\"b.1\">Único párrafo.</div></div>'"
)


def pages_with(planted: str) -> dict[str, str]:
    return {"page_id": "page_id", "html": f"replace(html, '</article>', {planted} || '</article>')"}


# EU acts whose title sits in the h1, in a meta tag, or in a titled div
_NO_H1 = "replace(replace(html, '<h1', '<h2'), '</h1>', '</h2>')"
EU_TITLE_PAGES = {
    "page_id": "page_id",
    "html": "CASE page_id % 3 WHEN 0 THEN html"
    f" WHEN 1 THEN replace({_NO_H1}, '</article>', '<meta name=\"DC.title\" content=\"Acto ' || url || '\"></article>')"
    f" ELSE replace({_NO_H1}, '</article>', '<div id=\"document-title\"> Acto <b>' || url || '</b></div></article>') END",
}


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def sql(table: str, columns: dict[str, str]) -> str:
    """The same projection as a query text."""
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {table}"


def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "documents"), CITED_DOCUMENTS)


def mention_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "lineitem"), MENTION_FACTS)


def law_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "part"), LAW_BLOCKS)


def law_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "lineitem"), LAW_MENTIONS)


def alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "part"), ALIAS_ROWS)


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "events"), JOB_LOG)


def lookup_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "events"), LOOKUP_CACHE)


def planted_pages(spark: SparkSession, sf_dir: str, planted: str) -> DataFrame:
    return project(read(spark, sf_dir, "pages"), pages_with(planted))


# -- requests over events, packed into five minutes so that a 60 s limit binds --------------------

REQUEST_LOG_SPARK = {
    "client": "user_id",
    "event_id": "event_id",
    "t_us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) % 300000000",
}
REQUEST_LOG_SQL = {
    "client": "user_id",
    "event_id": "event_id",
    "t_us": "CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) % 300000000 AS BIGINT)",
}


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "events"), REQUEST_LOG_SPARK)


# -- documents that name concepts, and the map of concepts to laws ------------------------------------

_ADJ = "CASE doc_id % 8 " + " ".join(
    f"WHEN {i} THEN '{w}'" for i, w in enumerate(["blue", "new", "cold", "red", "large", "small", "hot", "old"])
) + " END"
_NOUN = "CASE (doc_id * 5 + {shift}) % 8 " + " ".join(
    f"WHEN {i} THEN '{w}'" for i, w in enumerate(["ring", "bolt", "gear", "gizmo", "anvil", "plate", "rod", "widget"])
) + " END"
CONCEPT_NAMES = [
    f"{a} {n}"
    for a in ["blue", "new", "cold", "red", "large", "small", "hot", "old"]
    for n in ["ring", "bolt", "gear", "gizmo", "anvil", "plate", "rod", "widget"]
]
CONCEPT_DOCUMENTS = {
    "doc_id": "doc_id",
    "text": f"text || ' Trata de ' || {_ADJ} || ' ' || {_NOUN.format(shift=0)} || ' y de '"
    f" || {_ADJ} || ' ' || {_NOUN.format(shift='doc_id % 3')} || '.'",
}

#: concept -> law and article range, from the parts of that name
CONCEPT_MAP = (
    "SELECT p_name AS concept, 'Ley ' || min(p_type) AS law, min(p_type) AS boe_id,"
    " CASE WHEN min(p_partkey) % 7 = 0 THEN 'n/a' ELSE CAST(min(p_partkey) % 350 + 1 AS STRING) END AS first_article,"
    " CAST(min(p_partkey) % 350 + length(p_name) AS STRING) AS last_article,"
    " CAST(60 + count(*) % 40 AS INT) AS confidence FROM {part} GROUP BY p_name"
)
CONCEPT_ARTICLES = {"boe_id": "p_type", "number": "CAST((p_partkey * 7) % 400 + 1 AS STRING)"}

#: what a document cites: an order's parts as (law, article) pairs
CONCEPT_CITED = {
    "doc_id": "l_orderkey",
    "boe_id": "CASE l_suppkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'PROMO'"
    " WHEN 3 THEN 'LARGE' WHEN 4 THEN 'STANDARD' ELSE 'SMALL' END",
    "article": "CAST(l_partkey % 400 + 1 AS STRING)",
}


def concept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "documents"), CONCEPT_DOCUMENTS)


def concept_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return spark.sql(CONCEPT_MAP, part=part)


# -- answers of an external extractor over orders -----------------------------------------------------

_N1 = "CAST(o_custkey % 40 + 1 AS STRING)"
_R1 = (
    "'{\"texto_completo\": \"Ley ' || " + _N1 + " || '/2015\", \"tipo\": \"ley\", \"ley\": \"Ley ' || " + _N1
    + " || '/2015\", \"articulo\": null, \"confianza\": 95}'"
)
_R2 = (
    "'{\"texto_completo\": \"artículo ' || " + _N1 + " || ' CE\", \"tipo\": \"articulo\", \"ley\": \"CE\", \"articulo\": \"' || "
    + _N1 + " || '\", \"confianza\": 80}'"
)
_FULL = "'{\"referencias\": [' || " + _R1 + " || ', ' || " + _R2 + " || ']}'"
RESPONSES = {
    "doc_id": "o_orderkey",
    "raw": f"CASE WHEN o_orderkey % 7 = 0 THEN '```json {{\"referencias\": [' || {_R1}"
    f" WHEN o_orderkey % 3 = 0 THEN 'Resultado: ' || {_FULL}"
    f" WHEN o_orderkey % 3 = 1 THEN '```json' || chr(10) || {_FULL} || chr(10) || '```'"
    f" ELSE {_FULL} END",
}

_DOC_NO = "CAST(doc_id % 40 + 1 AS STRING)"
ANSWERED_DOCUMENTS = {
    "doc_id": "doc_id",
    "text": "replace(text, chr(160), ' ') || CASE doc_id % 3"
    f" WHEN 0 THEN ' y la LEY ' || {_DOC_NO} || '/2015, art ' || {_DOC_NO} || ' CE fin'"
    f" WHEN 1 THEN ' la Ley' || chr(10) || '  ' || {_DOC_NO} || '/2015 y ART.  ' || {_DOC_NO} || ' C.E fin' ELSE ' nada' END",
}
DOCUMENT_RESPONSES = {
    "doc_id": "doc_id",
    "raw": f"'{{\"referencias\": [{{\"texto_completo\": \"Ley ' || {_DOC_NO} || '/2015\", \"tipo\": \"ley\", \"confianza\": 90}},"
    f" {{\"texto_completo\": \"art. ' || {_DOC_NO} || ' C.E.\", \"tipo\": \"articulo\", \"confianza\": 80}},"
    " {\"texto_completo\": \"Ley 77/1777\", \"tipo\": \"ley\", \"confianza\": 70}]}'",
}

# -- payloads, references and names ---------------------------------------------------------------------

BROKEN_TOPICS = {
    "page_id": "page_id",
    "json": "CASE page_id % 3 WHEN 0 THEN '{\"document\": {\"documentVersion\": {\"contenido\": \"pagina ' || url || ' '"
    " || replace(replace(replace(html, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') || '\"}}}'"
    " WHEN 1 THEN '{\"document\": {\"documentVersion\": {\"contenido\" : \"' || html || '\"}}}'"
    " ELSE 'sin json ' || html END",
}
PARAGRAPH_DOCUMENTS = {
    "doc_id": "doc_id",
    "source": "source",
    "text": "replace(text, '. ', '.' || chr(10) || chr(10) || ' ')",
}
INDEX_XML = {
    "p_partkey": "p_partkey",
    "xml": "'<indice><bloque><id> a' || CAST(p_partkey AS STRING) || ' </id><titulo>Artículo ' || CAST(p_partkey AS STRING)"
    " || '. ' || p_name || '</titulo></bloque><bloque><id>ti</id>'"
    " || CASE WHEN p_size % 2 = 0 THEN '<titulo></titulo>' ELSE '<titulo>TÍTULO ' || p_type || '</titulo>' END"
    " || '<fecha_actualizacion>20240101</fecha_actualizacion></bloque></indice>'",
}
SEARCH_XML = {
    "p_partkey": "p_partkey",
    "p_size": "p_size",
    "kind": "CASE p_partkey % 4 WHEN 0 THEN 'Ley' WHEN 1 THEN 'Real Decreto' WHEN 2 THEN 'rd' ELSE 'Orden' END",
    "xml": "'<response><data><item><identificador>' || CASE WHEN p_size % 2 = 0 THEN 'BOE-B-2001-' || CAST(p_partkey AS STRING)"
    " ELSE 'DOUE-1' END || '</identificador><titulo>' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Ley primera' END"
    " || '</titulo></item><item><identificador>BOE-A-2015-' || CAST(p_partkey AS STRING) || '</identificador><titulo>LEY de ' || p_name"
    " || '</titulo></item><item><identificador> BOE-A-1999-' || CAST(p_partkey AS STRING) || ' </identificador><titulo>Real Decreto de '"
    " || p_name || '</titulo></item></data></response>'",
}
BLOCK_XML = {
    "p_partkey": "p_partkey",
    "xml": "'<response><status><code>' || CASE WHEN p_size % 5 = 0 THEN '404' ELSE '200' END"
    " || '</code></status><data><bloque titulo=\"Artículo ' || CAST(p_partkey AS STRING) || '\"><version><p>Uno.</p><p>' || p_name"
    " || '</p></version><version><p>viejo</p></version></bloque></data></response>'",
}
EU_META_JSON = {
    "p_partkey": "p_partkey",
    "json": "'{\"results\": {\"bindings\": [' || CASE WHEN p_size % 4 = 0 THEN '' ELSE '{\"work\": {\"value\": \"http://w/'"
    " || CAST(p_partkey AS STRING) || '\"}, \"titulo_es\": {\"value\": \"' || p_name || '\"}, \"fecha\": {\"value\": \"2016-04-27\"}}' END"
    " || ']}}'",
}
RAW_REFERENCES = {
    "mention_id": MENTION_FACTS["mention_id"],
    "raw": f"CASE l_linenumber % 3 WHEN 0 THEN '  Ley   nº ' || {_LAW_NO} || '/2015 ' WHEN 1 THEN 'Ley Núm. ' || {_LAW_NO}"
    f" || '/2015' ELSE 'Real  Decreto' || chr(10) || 'Nº' || {_LAW_NO} || '/2015' END",
}
ARTICLE_LISTS = {
    "mention_id": MENTION_FACTS["mention_id"],
    "article": "CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey % 90 + 1 AS STRING) || ' y ' || CAST(l_suppkey % 90 + 1 AS STRING)"
    " WHEN 1 THEN CAST(l_partkey % 90 + 1 AS STRING) || ', ' || CAST(l_suppkey % 90 + 1 AS STRING) || ', 7,8'"
    " ELSE CAST(l_partkey % 90 + 1 AS STRING) || '.2' END",
}
NOISY_MENTIONS = {
    "mention_id": MENTION_FACTS["mention_id"],
    "text": "CASE l_suppkey % 5 WHEN 0 THEN 'STC 12/2015' WHEN 1 THEN 'La Ley' WHEN 2 THEN 'sentencia STS 3/2014'"
    f" WHEN 3 THEN 'la ley orgánica' ELSE 'Ley ' || {_LAW_NO} || '/2015' END",
}
MODEL_CALLS = {
    "agent": "CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END",
    "prompt": "props",
    "ms": "value",
    "failed": "event_type = 'error'",
}
_TYPED_NAME = (
    "(CASE WHEN p_partkey % 5 = 0 THEN substr(p_name, 1, 2) || substr(p_name, 4)"
    " WHEN p_partkey % 7 = 3 THEN substr(p_name, 1, length(p_name) - 1) || 'x'"
    " WHEN p_partkey % 11 = 4 THEN p_name || 's' ELSE p_name END)"
)
NAME_SPELLINGS = {
    "law_name": f"CASE p_size % 3 WHEN 0 THEN 'Ley de la ' || {_TYPED_NAME} WHEN 1 THEN upper('ley ' || {_TYPED_NAME}) || '.'"
    f" ELSE substr({_TYPED_NAME}, instr({_TYPED_NAME}, ' ') + 1) || ' ' || substr({_TYPED_NAME}, 1, instr({_TYPED_NAME}, ' ') - 1) || ', Léy' END",
}
ALIAS_EDGES = {
    "ce": "constitución española",
    "lec": "ley 1/2000",
    "ley 1/2000": "ley de enjuiciamiento civil",
    "ley 39/2015": "lpac",
    "ley 40/2015": "lrjsp",
    "lpac": "ley 39/2015",
}
#: one answer for every mention of every batch
ANSWERS = {
    "doc_id": "doc_id",
    "batch_id": "batch_id",
    "idx": "idx",
    "law": "CASE (doc_id + batch_id + idx) % 3 WHEN 0 THEN 'Ley 1/2000' WHEN 1 THEN NULL ELSE 'CE' END",
    "confidence": "CASE WHEN (doc_id + idx) % 2 = 0 THEN NULL ELSE 97 END",
    "reason": "'contexto'",
}
ACRONYM_MENTIONS = {
    "mention_id": MENTION_FACTS["mention_id"],
    "kind": "CASE l_linenumber % 2 WHEN 0 THEN 'sigla' ELSE 'ley' END",
    "text": "upper(substr(p_name, 1, 1)) || upper(substr(p_name, instr(p_name, ' ') + 1, 1))",
    "dotted": "lower(substr(p_name, 1, 1)) || '.' || upper(substr(p_name, instr(p_name, ' ') + 1, 1)) || '.'",
    "context": "p_name || ' ' || lower(p_type)",
}
_PK = "CAST(p_partkey % 2000 + 1 AS STRING)"
EU_REFERENCES = {
    "p_partkey": "p_partkey",
    "text": f"CASE p_size % 9 WHEN 0 THEN 'Reglamento (UE) ' || CAST(2000 + p_partkey % 24 AS STRING) || '/' || {_PK}"
    f" WHEN 1 THEN 'Reglamento (CE) No ' || {_PK} || '/2008' WHEN 2 THEN 'Directiva 95/46/CE'"
    f" WHEN 3 THEN 'artículo 3 de la Directiva (UE) 2016/' || {_PK} WHEN 4 THEN 'Decisión (UE) 2017/' || {_PK}"
    f" WHEN 5 THEN 'Decisión Marco 2002/584/JAI' WHEN 6 THEN 'Reglamento (UE) No 1215/2012'"
    f" WHEN 7 THEN 'Ley 39/2015' ELSE 'Reglamento UE nº ' || {_PK} || '/2001' END",
}
LAW_NAMES = {
    "p_partkey": "p_partkey",
    "name": "CASE p_partkey % 10 WHEN 0 THEN 'RGPD' WHEN 1 THEN 'CP' WHEN 2 THEN 'LEC' WHEN 3 THEN 'Roma I'"
    " WHEN 4 THEN 'Ley 39/2015' WHEN 5 THEN 'Reglamento (UE) 2016/679' WHEN 6 THEN 'eIDAS' WHEN 7 THEN 'LOTC'"
    " WHEN 8 THEN 'rgpd' ELSE p_name END",
}
YEAR_REGISTRY = {
    "law_type": "CASE p_size % 2 WHEN 0 THEN 'Ley' ELSE 'Real Decreto' END",
    "number": "CAST(p_partkey % 100 + 1 AS INT)",
    "year": "CAST(1960 + p_size AS INT)",
    "boe_id": "'BOE-A-' || CAST(1960 + p_size AS STRING) || '-' || CAST(p_partkey AS STRING)",
}
YEAR_REFERENCES = {
    "mention_id": MENTION_FACTS["mention_id"],
    "law_type": "CASE l_suppkey % 2 WHEN 0 THEN 'Ley' ELSE 'Real Decreto' END",
    "number": "CAST(l_partkey % 100 + 1 AS INT)",
    "ref_year": "CAST(1965 + l_linenumber * 10 AS INT)",
}
CASCADE_REFERENCES = {
    "mention_id": MENTION_FACTS["mention_id"],
    "ref": "CASE l_linenumber % 7 WHEN 0 THEN ' LEC ' WHEN 1 THEN 'norma ' || CAST(l_partkey % 9 AS STRING)"
    " WHEN 2 THEN 'Ley nº ' || CAST(l_partkey % 100 + 1 AS STRING) || '/' || CAST(1961 + l_suppkey % 50 AS STRING)"
    " WHEN 3 THEN 'Real Decreto ' || CAST(l_partkey % 100 + 1 AS STRING) WHEN 4 THEN 'RD ' || CAST(l_partkey % 100 + 1 AS STRING) || '/1999'"
    " WHEN 5 THEN 'Ley Orgánica 77/2099, que cita la Ley ' || CAST(l_partkey % 100 + 1 AS STRING) || '/' || CAST(1961 + l_suppkey % 50 AS STRING)"
    " ELSE 'Ley Orgánica ' || CAST(l_partkey % 9 AS STRING) || '/1985' END",
    "title": "CASE WHEN l_linenumber % 7 = 1 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Ley 39/2015, de 1 de octubre' WHEN 1 THEN 'El Código Civil' END END",
    "ref_year": "CASE WHEN l_linenumber % 7 IN (2, 4) THEN 1965 + l_suppkey % 50 WHEN l_linenumber % 7 = 5 THEN 2099 END",
}
REGISTRY_ARTICLES = {
    "boe_id": "CASE p_partkey % 2 WHEN 0 THEN 'BOE-A-2015-7391' ELSE 'BOE-A-2015-10565' END",
    "number": "CAST(p_partkey % 3 + 1 AS STRING)",
}
EU_ACTS = {
    "celex": "CASE page_id % 3 WHEN 0 THEN '32016R0679' WHEN 1 THEN '32014R0910' ELSE '32010R1259' END",
    "title": "'Acto ' || CAST(page_id % 3 AS STRING)",
}
LAW_TITLES = {
    "boe_id": "'BOE-A-2015-' || CAST(n_nationkey + 1 AS STRING)",
    "law_title": "'Ley ' || CAST(n_nationkey + 1 AS STRING) || '/2015, de ' || n_name",
}
ARTICLE_TEXTS = {
    "boe_id": "'BOE-A-2015-' || CAST(p_partkey % 26 + 1 AS STRING)",
    "number": "CAST(p_partkey % 3 + 1 AS STRING)",
    "article_text": "'<p>Texto del artículo ' || CAST(p_partkey % 3 + 1 AS STRING) || '</p>'",
}
_ENRICH_LAW = "CAST(l_partkey % 26 + 1 AS STRING)"
ENRICH_MENTIONS = {
    "doc_id": "l_orderkey",
    "mention_id": MENTION_FACTS["mention_id"],
    "text": f"CASE l_linenumber % 7 WHEN 0 THEN 'artículo 2.1.a de la Ley ' || {_ENRICH_LAW} || '/2015' WHEN 1 THEN 'Ley ' || {_ENRICH_LAW} || '/2015'"
    f" WHEN 2 THEN 'art. ' || CAST(l_suppkey % 4 + 1 AS STRING) || ' de la Ley ' || {_ENRICH_LAW} || '/2015' WHEN 3 THEN 'artículos 22 y 25 del Reglamento (UE) 2016/679'"
    " WHEN 4 THEN 'art. ' || CAST(l_suppkey % 40 + 1 AS STRING) || ' del Reglamento (UE) 2014/910' WHEN 5 THEN 'art. 456 LEC' ELSE 'Ley 3' END",
    "law": f"CASE WHEN l_linenumber % 7 = 5 THEN 'LEC' WHEN l_linenumber % 7 < 3 THEN 'Ley ' || {_ENRICH_LAW} || '/2015' END",
    "article": "CASE l_linenumber % 7 WHEN 0 THEN '2.1.a' WHEN 2 THEN '0' || CAST(l_suppkey % 4 + 1 AS STRING) WHEN 3 THEN '22 y 25'"
    " WHEN 4 THEN 'art_' || CAST(l_suppkey % 40 + 1 AS STRING) WHEN 5 THEN '456' END",
    "boe_id": f"CASE WHEN l_linenumber % 7 IN (0, 1, 2, 5) THEN 'BOE-A-2015-' || {_ENRICH_LAW} END",
    "kind": "CASE l_linenumber % 7 WHEN 1 THEN 'ley' WHEN 5 THEN 'Título' WHEN 0 THEN 'capítulo' ELSE 'articulo' END",
    "start": MENTION_FACTS["start"],
    "inferred": "CASE WHEN l_linenumber % 7 = 1 AND l_suppkey % 3 > 0 THEN CAST(l_suppkey % 3 AS STRING) || ',3' END",
}
ENRICH_ARTICLES = {
    "boe_id": "'BOE-A-2015-' || CAST(p_partkey % 26 + 1 AS STRING)",
    "number": "CASE p_size % 4 WHEN 3 THEN 'acuatrocientoscincuentayseis' ELSE CAST(p_size % 4 + 1 AS STRING) END",
    "article_title": "CASE WHEN p_size > 9 THEN 'Artículo ' || CAST(p_size % 4 + 1 AS STRING) || '. ' || p_type END",
    "article_text": "'<p>Texto ' || p_name || '</p>'",
}
ENRICH_EU_ARTICLES = {
    "celex": EU_ACTS["celex"],
    "number": "CAST(page_id % 31 + 1 AS STRING)",
    "title": "CASE WHEN page_id % 2 = 0 THEN 'Título ' || CAST(page_id % 5 AS STRING) END",
    "text": "'Texto de ' || url",
}
PAGE_CELEX = "'3' || CAST(2000 + {k} % 20 AS STRING) || 'R' || lpad(CAST({k} % 50 AS STRING), 4, '0')"
EU_WANTED = {
    "celex": PAGE_CELEX.format(k="l_partkey"),
    "article": "CASE l_suppkey % 2 WHEN 0 THEN 'art_' ELSE '' END || CAST(l_partkey % 40 + 1 AS STRING)",
}
