"""Building blocks of the check queries (DuckDB dialect). They state the semantics a second time,
row-wise and without the library's expressions."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from citelake import dims
from citelake.functions import legal
from citelake.operators import extract
from citelake.plans import fixtures as fx


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    def lit(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


def mapping(d: dict[str, str]) -> str:
    """Sub-select (k, v) of a dictionary."""
    return "(SELECT k, v FROM " + values(list(d.items()), "k, v") + ")"


CITED = fx.sql("documents", fx.CITED_DOCUMENTS)
FACTS = fx.sql("lineitem", fx.MENTION_FACTS)
BLOCKS = fx.sql("part", fx.LAW_BLOCKS)
LAW_MENTIONS = fx.sql("lineitem", fx.LAW_MENTIONS)


def ctes(**parts: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in parts.items()) + " "


# -- extraction ------------------------------------------------------------------


def hits(source: str, pattern: str, extra: str = "") -> str:
    """(doc_id, start, text) of all matches of a pattern, with 0-based offsets."""
    p = q("(?i)" + pattern)
    return (
        "SELECT doc_id, CAST(list_sum(list_transform(s[1:i], lambda x: length(x)))"
        " + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start,"
        f" m[i] AS text{extra} FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS s"
        f" FROM {source}), unnest(range(1, len(m) + 1)) AS u(i)"
    )


def mentions(agents: str = "ABC", source: str = "docs") -> str:
    parts = []
    for agent, kind, pattern, whole, confidence, implicit in dims.PROFILE_PATTERNS:
        if agent not in agents:
            continue
        group = f"regexp_extract(text, {q('(?i)' + pattern)}, 1)"
        law = "text" if whole else "NULL" if kind == "articulo" else group
        article = group if kind == "articulo" else "NULL"
        parts.append(
            f"SELECT doc_id, sha256(concat_ws('|', doc_id, {q(agent)}, {q(kind)}, start, text)) AS mention_id,"
            f" {q(agent)} AS agent, {q(kind)} AS kind, text, CAST({law} AS VARCHAR) AS law, CAST({article} AS VARCHAR) AS article,"
            f" {confidence} AS confidence, CAST({'true' if implicit else 'NULL'} AS BOOLEAN) AS implicit, start"
            f" FROM ({hits(source, pattern)})"
        )
    return " UNION ALL ".join(parts)


LAW_FORMS = [
    ("organica", r"^Ley\s+Orgánica\s+(\d+/\d{4})", "Ley Orgánica"),
    ("ordinaria", r"^Ley\s+(\d+/\d{4})", "Ley"),
    ("real_decreto_ley", r"^(?:Real\s+Decreto[\s-]+Ley|RDL)\s+(\d+/\d{4})", "Real Decreto-ley"),
    ("real_decreto_legislativo", r"^(?:Real\s+Decreto\s+Legislativo|RDLeg)\s+(\d+/\d{4})", "Real Decreto Legislativo"),
    ("real_decreto", r"^(?:Real\s+Decreto|RD)\s+(\d+/\d{4})", "Real Decreto"),
]


def law_form(column: str) -> tuple[str, str]:
    c = f"trim({column})"
    canonical = "CASE " + " ".join(
        f"WHEN regexp_matches({c}, {q('(?i)' + p)}) THEN {q(prefix + ' ')} || regexp_extract({c}, {q('(?i)' + p)}, 1)"
        for _, p, prefix in LAW_FORMS
    ) + " END"
    kind = "CASE " + " ".join(
        f"WHEN regexp_matches({c}, {q('(?i)' + p)}) THEN {q(k)}" for k, p, _ in LAW_FORMS
    ) + " END"
    return canonical, kind


def normalized(source: str) -> str:
    law, kind = law_form("law")
    by_text, text_kind = law_form("text")
    return f"SELECT *, coalesce({law}, {by_text}) AS law_norm, coalesce({kind}, {text_kind}) AS law_type FROM {source}"


def law_info(source: str) -> str:
    in_text = ", ".join(f"nullif(regexp_extract(text, {q('(?i)' + p)}), '')" for p in legal.LAW_IN_TEXT)
    return (
        f"SELECT *, CAST(nullif(regexp_extract(ref, '(\\d{{4}})', 1), '') AS INTEGER) AS ref_year FROM"
        f" (SELECT *, coalesce(nullif(law_norm, ''), nullif(law, ''), {in_text}) AS ref FROM {source})"
    )


def clean_reference(c: str) -> str:
    one = f"regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    one = f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({one}, '(?i)nº\\s*', '', 'g'), '(?i)núm\\.\\s*', '', 'g')"


def numbered_key(c: str) -> str:
    forms = [
        ("real decreto-ley", r"Real\s+Decreto[\s-]+Ley\s+(\d+/\d{4})"),
        ("real decreto legislativo", r"Real\s+Decreto\s+Legislativo\s+(\d+/\d{4})"),
        ("ley orgánica", r"Ley\s+Orgánica\s+(\d+/\d{4})"),
        ("ley", r"Ley\s+(\d+/\d{4})"),
        ("real decreto", r"Real\s+Decreto\s+(\d+/\d{4})"),
        ("real decreto", r"RD\s+(\d+/\d{4})"),
    ]
    return "CASE " + " ".join(
        f"WHEN regexp_matches({c}, {q('(?i)' + p)}) THEN {q(k + ' ')} || regexp_extract({c}, {q('(?i)' + p)}, 1)" for k, p in forms
    ) + " END"


def registry_ids(source: str) -> str:
    """source(…, ref, title) plus boe_id and found_by."""
    reg = mapping(dims.registry_entries())
    word = "CASE " + " ".join(f"WHEN contains(lower(title), {q(w)}) THEN {q(i)}" for w, i in dims.TITLE_REGISTRY.items()) + " END"
    return (
        f"SELECT s.*, coalesce(a.v, b.v, {word}, c.v) AS boe_id, CASE WHEN a.v IS NOT NULL THEN 'name'"
        f" WHEN coalesce(b.v, {word}) IS NOT NULL THEN 'title' WHEN c.v IS NOT NULL THEN 'number' END AS found_by"
        f" FROM {source} s LEFT JOIN {reg} a ON lower(trim(s.ref)) = a.k LEFT JOIN {reg} b ON {numbered_key('s.title')} = b.k"
        f" LEFT JOIN {reg} c ON {numbered_key(clean_reference('s.ref'))} = c.k"
    )


def normal_article(c: str) -> str:
    bare = f"trim(regexp_replace(lower({c}), '(?i)^(?:artículo|art\\.?)\\s*', ''))"
    return f"coalesce(nullif(regexp_extract({bare}, '^(\\d+(?:\\.\\d+)?)', 1), ''), {bare})"


def is_acronym(kind: str, text: str) -> str:
    return (
        f"coalesce(lower({kind}) = 'sigla' OR (length({text}) < 10 AND upper({text}) = {text} AND lower({text}) <> {text}), false)"
    )


def canonical_key() -> str:
    law = "replace(trim(lower(coalesce(law, ''))), ' ', '')"
    art = "trim(lower(coalesce(article, '')))"
    return (
        f"CASE WHEN coalesce(boe_id, '') <> '' THEN 'BOE:' || boe_id WHEN {art} <> '' THEN {law} || ':art' || {art} ELSE {law} END"
    )


EXPORT_WORDS = "|".join(re.escape(p).replace("\\ ", " ") for p in dims.EU_EXPORT_FORMS)
EXPORTABLE = f"((boe_id IS NOT NULL AND boe_id <> '') OR coalesce(regexp_matches(text, {q(EXPORT_WORDS)}), false))"


def rx(pattern: str) -> str:
    """A pattern as RE2 takes it: no escaped blanks."""
    return pattern.replace("\\ ", " ")


EU_PATTERN = q("(?i)" + rx(legal.eu_pattern()))
EU_HITS = hits("docs", rx(extract.EU_ACT))


def celex_raw(c: str) -> str:
    out = []
    for word, letter in legal.EU_ACTS:
        p = q("(?i)" + word + r"\s*(?:\(UE\)|\(CE\)|UE|CE)?\s*(?:No|N[oº])?\s*(\d+)/(\d+)")
        a, b = (f"CAST(regexp_extract({c}, {p}, {g}) AS INTEGER)" for g in (1, 2))
        out.append(
            f"WHEN regexp_matches({c}, {p}) THEN CASE WHEN {a} >= 1000 THEN printf('3%d{letter}%04d', {a}, {b})"
            f" ELSE printf('3%d{letter}%04d', {b}, {a}) END"
        )
    return "CASE " + " ".join(out) + " END"


def celex(c: str) -> str:
    out = []
    for word, letter in [("Reglamento", "R"), ("Directiva", "L"), (r"Decisión\s+Marco", "F"), ("Decisión", "D")]:
        p = q("(?i)" + word + r"\s*(?:\(UE\)|\(CE\)|UE|CE)?\s*(No|N[oº])?\s*(\d+)/(\d+)")
        n = f"regexp_extract({c}, {p}, 1) <> ''"
        a, b = (f"CAST(regexp_extract({c}, {p}, {g}) AS INTEGER)" for g in (2, 3))
        out.append(
            f"WHEN regexp_matches({c}, {p}) THEN CASE WHEN {a} BETWEEN 1950 AND 2100 AND NOT ({n}) THEN printf('3%d{letter}%04d', {a}, {b})"
            f" WHEN {a} < 100 AND NOT ({n}) AND NOT ({b} BETWEEN 1950 AND 2100) THEN printf('3%d{letter}%04d', 1900 + {a}, {b})"
            f" ELSE printf('3%d{letter}%04d', CASE WHEN {b} < 100 THEN {b} + 1900 ELSE {b} END, {a}) END"
        )
    return "CASE " + " ".join(out) + " END"


# -- markup ---------------------------------------------------------------------------


def inner(c: str) -> str:
    return _unescaped(f"regexp_replace({c}, '\\s*<[^>]*>\\s*', '', 'g')")


def stripped(c: str) -> str:
    return _unescaped(f"regexp_replace({c}, '<[^>]+>', '', 'g')")


def _unescaped(c: str) -> str:
    named = [(f"&{n};", f"chr({code})") for n, code in name2codepoint.items() if n != "amp"]
    for entity, char in [*named, ("&#39;", "chr(39)"), ("&amp;", "chr(38)")]:
        c = f"replace({c}, '{entity}', {char})"
    return f"trim(regexp_replace({c}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def segments(source: str, key: str = "page_id") -> str:
    """(key, pos, tag, attrs, text, raw): the pieces of a page between block tags."""
    visible = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g')"
    cut = (
        f"string_split(regexp_replace({visible}, '(?i)<(/?(?:h[1-6]|p|li|ul|ol|div|article|section|header|footer|nav|body|html|table|tr|td)[ >])',"
        " chr(1) || '<\\1', 'g'), chr(1))"
    )
    return (
        f"SELECT {key}, pos, lower(regexp_extract(raw, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, regexp_extract(raw, '^<[^>]*>') AS attrs,"
        f" {inner('raw')} AS text, raw FROM (SELECT {key}, s[i] AS raw, i AS pos FROM (SELECT {key}, {cut} AS s FROM {source}),"
        " unnest(range(1, len(s) + 1)) AS u(i))"
    )


def pages(planted: str) -> str:
    return fx.sql("pages", fx.pages_with(planted))


# -- audit -------------------------------------------------------------------------------

CONF = "coalesce(confidence, 0)"
PROFILE = (
    "SELECT doc_id, count(*) AS total, round(avg(CF), 6) AS mean_confidence, min(CF) AS min_confidence, max(CF) AS max_confidence,"
    " count(*) FILTER (CF >= 90) AS high, count(*) FILTER (CF >= 70 AND CF < 90) AS medium, count(*) FILTER (CF < 70) AS low,"
    " count(*) FILTER (coalesce(validated, false)) AS validated,"
    " count(*) - count(*) FILTER (coalesce(validated, false)) AS not_validated,"
    " round(count(*) FILTER (coalesce(validated, false)) / count(*), 6) AS rate,"
    " count(*) FILTER (coalesce(boe_id <> '', false)) AS ids_found,"
    " count(*) FILTER (kind IN ('ley', 'real_decreto', 'sigla')) AS laws, count(*) FILTER (kind = 'articulo') AS articles,"
    " list_sort(list_distinct(list(kind))) AS kinds, count(*) - count(DISTINCT text) AS duplicates FROM facts GROUP BY doc_id"
).replace("CF", CONF)

GRADED = (
    "SELECT *, round(round(note, 6), 1) AS grade, CASE WHEN note >= 8 THEN 'Excelente' WHEN note >= 6 THEN 'Bueno'"
    " WHEN note >= 4 THEN 'Aceptable' ELSE 'Requiere Revisión' END AS level, CASE WHEN note >= 8 THEN '🌟' WHEN note >= 6 THEN '✅'"
    " WHEN note >= 4 THEN '⚠️' ELSE '❌' END AS emoji, round(mean_confidence / 10, 1) AS confidence_factor,"
    " round(rate * 10, 1) AS validation_factor, round(CAST(least(len(kinds), 5) * 2 AS DOUBLE), 1) AS coverage_factor FROM"
    " (SELECT *, mean_confidence / 10 * CAST(0.4 AS DOUBLE) + rate * 10 * CAST(0.4 AS DOUBLE)"
    " + least(len(kinds), 5) * 2 * CAST(0.2 AS DOUBLE) AS note FROM profile)"
)

PCT = "CAST(round({x}, 1) AS VARCHAR)"


def problem_rows(converged: str | None) -> str:
    rows = [
        ("alta", "validacion_baja", "CAST(validated AS DOUBLE) / total < 0.5",
         "'Tasa de validación muy baja: ' || " + PCT.format(x="100.0::DOUBLE * validated / total") + " || '% (esperado >50%)'",
         "Revisar manualmente las referencias no validadas o expandir el mapeo de leyes"),
        ("media", "confianza_baja", "low > total * CAST(0.3 AS DOUBLE)",
         "low || ' referencias con confianza <70% (' || " + PCT.format(x="100.0::DOUBLE * low / total") + " || '%)'",
         "Revisar manualmente las referencias de baja confianza"),
    ]
    if converged:
        rows.append(("media", "sin_convergencia", f"NOT coalesce({converged}, false)",
                     "'No se alcanzó convergencia en las rondas permitidas'",
                     "Considerar aumentar el número máximo de rondas o revisar el texto"))
    rows += [
        ("alta", "pocas_referencias", "total < 5", "'Solo se encontraron ' || total || ' referencias'",
         "El tema puede tener pocas referencias legales o los agentes necesitan ajuste"),
        ("baja", "duplicados", "duplicates > 0", "duplicates || ' referencias duplicadas detectadas'",
         "Revisar el filtrado de duplicados en el sistema de convergencia"),
    ]
    return " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, {q(sev)} AS severity, {q(name)} AS problem, {text} AS description, {q(action)} AS action FROM profile WHERE {cond}"
        for n, (sev, name, cond, text, action) in enumerate(rows)
    )


def suggestion_rows() -> str:
    rows = [
        (f"mean_confidence < 70", q("⚠️ Confianza promedio baja - Considerar revisar manualmente todas las referencias")),
        ("low > 0", "'🔍 ' || low || ' referencias requieren revisión manual'"),
        ("rate < 0.7", q("📝 Expandir el mapeo de leyes comunes en el BOESearcher para mejorar validación")),
        ("not_validated > 0", "'✅ Validar manualmente ' || not_validated || ' referencias contra el BOE'"),
        ("articles = 0 AND laws > 0", q("🎯 Solo se encontraron leyes, sin artículos específicos - Tema puede ser muy general")),
        ("(CAST(validated AS DOUBLE) / total < 0.5 OR total < 5)", q("⚠️ Se detectaron problemas de severidad ALTA - Revisión urgente recomendada")),
    ]
    fired = " UNION ALL ".join(f"SELECT doc_id, {n} AS o, {text} AS suggestion FROM profile WHERE {cond}" for n, (cond, text) in enumerate(rows))
    none = " AND ".join(f"NOT ({cond})" for cond, _ in rows)
    return (
        f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS n, suggestion FROM ({fired}"
        f" UNION ALL SELECT doc_id, 0 AS o, {q('✅ La extracción parece correcta - Revisión manual opcional')} AS suggestion FROM profile WHERE {none})"
    )


# -- consensus ---------------------------------------------------------------------------------

KEYED = f"SELECT *, {canonical_key()} AS key FROM facts"
LEVELS = (
    "SELECT doc_id, CAST(any_value(present) AS INTEGER) AS agents_present, count(*) AS distinct_keys,"
    " count(*) FILTER (n = present) AS total_consensus, count(*) FILTER (n >= 2 AND n < present) AS partial_consensus"
    " FROM (SELECT doc_id, key, count(DISTINCT agent) AS n FROM keyed GROUP BY doc_id, key)"
    " JOIN (SELECT doc_id, count(DISTINCT agent) AS present FROM keyed GROUP BY doc_id) USING (doc_id) GROUP BY doc_id"
)
RANK = "CASE agent WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END"
