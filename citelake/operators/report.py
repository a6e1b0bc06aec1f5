"""Reports as ordered blocks of text, so that no document's report is ever one string in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelake.functions.legal import registry_url
from citelake.functions.text import none_if_empty, strip_tags
from citelake.operators.audit import low_confidence_first, one_decimal
from citelake.operators.ordered import number_rows


def _line(text: Column | str, *, when: Column | None = None) -> Column:
    value = F.lit(text) if isinstance(text, str) else text
    return value if when is None else F.when(when, value)


def _lines(*lines: Column) -> Column:
    """Lines joined by line ends; null lines are left out."""
    return F.concat_ws("\n", *lines)


def _labelled(label: str, value: Column) -> Column:
    """``label`` and value; null where the value is."""
    return F.concat(F.lit(label), value)


def _link(value: Column) -> Column:
    return F.concat(F.lit("["), value, F.lit("]("), value, F.lit(")"))


def _structural(kind: Column, chapter: str, title: str) -> Column:
    folded = F.translate(F.lower(kind), "íáéóú", "iaeou")
    return F.when(folded.contains("capitulo"), F.lit(chapter)).when(folded.contains("titulo"), F.lit(title))


def _optional(mentions: DataFrame, columns: list[str]) -> DataFrame:
    for name in columns:
        if name not in mentions.columns:
            mentions = mentions.withColumn(name, F.lit(None).cast("string"))
    return mentions


_OPTIONAL = [
    "law_title", "law_expanded", "eu_url", "celex", "eu_title", "article_title", "article_text", "eu_article_title", "eu_article_text",
]


def _numbered(verified: DataFrame, width: int) -> DataFrame:
    ties = ("mention_id",) if "mention_id" in verified.columns else ()
    return number_rows(_optional(verified, _OPTIONAL), ["doc_id"], "start", "seq", width, ties)


def _article(field: str) -> Column:
    """Title or text of the article; that of an EU act goes first."""
    return none_if_empty(F.coalesce(none_if_empty(F.col(f"eu_article_{field}")), F.col(f"article_{field}")))


def _counts(verified: DataFrame, inferred: DataFrame | None) -> DataFrame:
    rows = verified.select("doc_id", F.lit(1).alias("v"), F.lit(0).alias("i"))
    if inferred is not None:
        rows = rows.unionByName(inferred.select("doc_id", F.lit(0).alias("v"), F.lit(1).alias("i")))
    return rows.groupBy("doc_id").agg(F.sum("v").alias("verified"), F.sum("i").alias("inferred"))


def first_articles(inferred: DataFrame, k: int = 20) -> DataFrame:
    """One row per inferred norm with its first ``k`` articles as text and dots when there are more."""
    keys = ["doc_id", "concept", "law", "boe_id", "confidence"]
    order = W.partitionBy("doc_id", "concept", "boe_id").orderBy(F.col("article").cast("int"), "article")
    first = inferred.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__n", "article"))).alias("__a")).select(
        *keys,
        F.concat(
            F.array_join(F.transform(F.slice("__a", 1, k), lambda x: x["article"]), ", "),
            F.when(F.size("__a") > k, F.lit("...")).otherwise(F.lit("")),
        ).alias("articles"),
    )


def report_markdown(verified: DataFrame, as_of: str, width: int, inferred: DataFrame | None = None) -> DataFrame:
    """Markdown report: (doc_id, section, seq, block). Section 0 is the head, 1 the verified mentions,
    2 the head of the inferred norms, 3 the inferred norms. FIXED VALUES: the wording."""
    numbered = _numbered(verified, width)
    url = registry_url(F.col("boe_id"))
    block = _lines(
        F.concat(F.lit("## "), F.col("seq").cast("string"), F.lit(". "), F.coalesce("text", F.lit("N/A"))),
        F.lit(""),
        _labelled("", F.concat(F.lit("**"), F.coalesce("law_title", "law_expanded"), F.lit("**\n"))),
        _labelled("", _structural(F.col("kind"), "**Tipo:** Capítulo\n", "**Tipo:** Título de código\n")),
        _labelled("**BOE-ID:** ", F.col("boe_id")),
        F.concat(F.lit("**BOE URL:** "), _link(url), F.lit("\n")),
        F.when(F.col("eu_url").isNotNull(), _lines(
            _labelled("**CELEX:** ", F.col("celex")),
            _labelled("**EUR-Lex:** ", _link(F.col("eu_url"))),
            _labelled("**Título:** ", F.col("eu_title")),
            F.lit(""),
        )),
        F.when(_article("text").isNotNull(), _lines(
            F.lit("### Texto del Artículo\n"),
            F.concat(F.lit("**"), _article("title"), F.lit("**\n")),
            F.concat(strip_tags(_article("text")), F.lit("\n")),
        )),
        F.lit("---\n"),
    )
    body = numbered.select("doc_id", F.lit(1).alias("section"), "seq", block.alias("block"))
    head = _counts(verified, inferred).select(
        "doc_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("seq"),
        _lines(
            F.lit("# REFERENCIAS LEGALES EXTRAÍDAS\n"),
            F.concat(F.lit("**Tema:** "), F.col("doc_id").cast("string")),
            F.lit(f"**Fecha:** {as_of}"),
            F.concat(F.lit("**Total referencias verificadas:** "), F.col("verified").cast("string")),
            F.when(F.col("inferred") > 0, F.concat(F.lit("**Total referencias inferidas (BETA):** "), F.col("inferred").cast("string"))),
            F.lit("\n---\n\n# 📋 SECCIÓN 1: REFERENCIAS VERIFICADAS\n"),
            F.lit("Estas referencias han sido extraídas directamente del texto y validadas contra el BOE oficial.\n\n---\n"),
        ).alias("block"),
    )
    out = head.unionByName(body)
    if inferred is None:
        return out
    # the order of inferred norms: most confident first; the position is a dense number over few norms
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("confidence"), "concept", "boe_id"))
    norms = inferred.withColumn("seq", place.cast("long"))
    norm_block = _lines(
        F.concat(F.lit("## BETA-"), F.col("seq").cast("string"), F.lit(". "), F.coalesce("law", F.lit("Ley desconocida")), F.lit("\n")),
        F.concat(F.lit("**Concepto detectado:** "), F.col("concept")),
        F.concat(F.lit("**Confianza IA:** "), F.col("confidence").cast("string"), F.lit("%")),
        F.concat(F.lit("**Artículos sugeridos:** "), F.col("articles"), F.lit("\n")),
        _labelled("**BOE-ID:** ", F.col("boe_id")),
        F.concat(F.lit("**BOE URL:** "), _link(url), F.lit("\n")),
        F.lit("---\n"),
    )
    norm_head = inferred.select("doc_id").distinct().select(
        "doc_id", F.lit(2).alias("section"), F.lit(0).cast("long").alias("seq"),
        F.lit(
            "\n# 🧠 SECCIÓN 2: POSIBLES NORMAS INFERIDAS (BETA)\n\n"
            "⚠️ **IMPORTANTE:** Estas referencias han sido sugeridas por IA basándose en conceptos legales detectados en el texto.\n\n"
            "**No fueron mencionadas explícitamente** en el material de estudio, pero pueden ser relevantes para el tema.\n\n"
            "✅ **Recomendación:** Verifica estas referencias con tu material de estudio antes de incluirlas.\n\n---\n"
        ).alias("block"),
    )
    return out.unionByName(norm_head).unionByName(
        norms.select("doc_id", F.lit(3).alias("section"), "seq", norm_block.alias("block"))
    )


def report_text(verified: DataFrame, as_of: str, width: int, inferred: DataFrame | None = None) -> DataFrame:
    """Plain-text report: (doc_id, section, seq, block), sections as in the Markdown report, 9 the last line.
    FIXED VALUES: the wording."""
    numbered = _numbered(verified, width)
    rule, thin = "=" * 80, "-" * 80
    block = _lines(
        F.lit(thin),
        F.concat(F.col("seq").cast("string"), F.lit(". "), F.coalesce("text", F.lit("N/A"))),
        F.lit(thin + "\n"),
        F.concat(F.lit("LEY: "), F.coalesce("law_title", "law_expanded"), F.lit("\n")),
        _structural(F.col("kind"), "TIPO: Capítulo\n", "TIPO: Título de código\n"),
        _labelled("BOE-ID: ", F.col("boe_id")),
        F.concat(F.lit("BOE URL: "), registry_url(F.col("boe_id")), F.lit("\n")),
        F.when(F.col("eu_url").isNotNull(), _lines(
            _labelled("CELEX: ", F.col("celex")),
            _labelled("EUR-Lex URL: ", F.col("eu_url")),
            _labelled("Título EUR-Lex: ", F.col("eu_title")),
            F.lit(""),
        )),
        F.when(F.col("article").isNotNull() & _article("text").isNotNull(), _lines(
            F.lit("TEXTO DEL ARTÍCULO:\n"),
            F.concat(_article("title"), F.lit("\n")),
            F.concat(strip_tags(_article("text")), F.lit("\n")),
        )),
        F.lit(""),
    )
    head = _lines(
        F.lit(f"{rule}\nREFERENCIAS LEGALES EXTRAÍDAS\n{rule}\n"),
        F.concat(F.lit("Tema: "), F.col("doc_id").cast("string")),
        F.lit(f"Fecha: {as_of}"),
        F.concat(F.lit("Total referencias verificadas: "), F.col("verified").cast("string")),
        F.when(F.col("inferred") > 0, F.concat(F.lit("Total referencias inferidas (BETA): "), F.col("inferred").cast("string"))),
        F.lit(f"\n{rule}\n\nSECCIÓN 1: REFERENCIAS VERIFICADAS\n"),
        F.lit(f"Estas referencias han sido extraídas directamente del texto y validadas\ncontra el BOE oficial.\n\n{rule}\n"),
    )
    counts = _counts(verified, inferred)
    parts = [
        counts.select("doc_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("seq"), head.alias("block")),
        numbered.select("doc_id", F.lit(1).alias("section"), "seq", block.alias("block")),
        counts.select("doc_id", F.lit(9).alias("section"), F.lit(0).cast("long").alias("seq"), F.lit(rule).alias("block")),
    ]
    if inferred is not None:
        place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("confidence"), "concept", "boe_id"))
        norm = _lines(
            F.lit(thin),
            F.concat(F.lit("BETA-"), F.col("seq").cast("string"), F.lit(". "), F.coalesce("law", F.lit("Ley desconocida"))),
            F.lit(thin + "\n"),
            F.concat(F.lit("Concepto detectado: "), F.col("concept")),
            F.concat(F.lit("Confianza IA: "), F.col("confidence").cast("string"), F.lit("%")),
            F.concat(F.lit("Artículos sugeridos: "), F.col("articles"), F.lit("\n")),
            _labelled("BOE-ID: ", F.col("boe_id")),
            F.concat(F.lit("BOE URL: "), registry_url(F.col("boe_id")), F.lit("\n")),
            F.lit(""),
        )
        inferred_head = (
            f"\n{rule}\nSECCIÓN 2: POSIBLES NORMAS INFERIDAS (BETA)\n{rule}\n\n"
            "IMPORTANTE: Estas referencias han sido sugeridas por IA basándose en\nconceptos legales detectados en el texto.\n\n"
            "No fueron mencionadas explícitamente en el material de estudio, pero\npueden ser relevantes para el tema.\n\n"
            f"RECOMENDACIÓN: Verifica estas referencias con tu material de estudio\nantes de incluirlas.\n\n{rule}\n"
        )
        parts += [
            inferred.select("doc_id").distinct().select("doc_id", F.lit(2).alias("section"), F.lit(0).cast("long").alias("seq"), F.lit(inferred_head).alias("block")),
            inferred.withColumn("seq", place.cast("long")).select("doc_id", F.lit(3).alias("section"), "seq", norm.alias("block")),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report(blocks: DataFrame, path: str) -> None:
    """Write report blocks as text in document order. Files hold ranges of documents; a large document
    runs over several files."""
    ordered = blocks.repartitionByRange("doc_id", "section", "seq").sortWithinPartitions("doc_id", "section", "seq")
    ordered.select("block").write.mode("overwrite").text(path)


def report_json(results: DataFrame) -> DataFrame:
    """The result rows as JSON text, one object per mention."""
    return results.select("doc_id", "mention_id", F.to_json(F.struct(*[c for c in results.columns if c not in ("doc_id", "mention_id")])).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def consensus_report(levels: DataFrame, unique: DataFrame, sizes: DataFrame) -> DataFrame:
    """Text of the comparison per document. ``sizes(doc_id, agent, mentions)``; agents are few."""
    def per_agent(df: DataFrame, value: str, suffix: str, out: str) -> DataFrame:
        line = F.concat(F.lit("   - "), F.col("agent"), F.lit(": "), F.col(value).cast("string"), F.lit(suffix))
        return df.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias(out))

    joined = levels.join(per_agent(sizes, "mentions", " referencias", "size_lines"), "doc_id").join(
        per_agent(unique, "unique_keys", " únicas", "unique_lines"), "doc_id", "left"
    )
    agreement = 100.0 * (F.col("total_consensus") + F.col("partial_consensus")) / F.col("distinct_keys")
    text = _lines(
        F.lit("=" * 60), F.lit("📊 INFORME DE COMPARACIÓN DE AGENTES"), F.lit("=" * 60),
        F.concat(F.lit("\n🤖 Agentes analizados: "), F.col("agents_present").cast("string")),
        F.lit("\n📋 Referencias por agente:"), F.col("size_lines"),
        F.concat(F.lit("\n✅ Consenso Total: "), F.col("total_consensus").cast("string"), F.lit(" referencias")),
        F.concat(F.lit("⚠️  Consenso Parcial: "), F.col("partial_consensus").cast("string"), F.lit(" referencias")),
        F.lit("\n🎯 Únicas por agente:"), F.col("unique_lines"),
        F.lit("\n📊 Métricas:"),
        F.concat(F.lit("   - Total referencias únicas: "), F.col("distinct_keys").cast("string")),
        F.concat(F.lit("   - Acuerdo promedio: "), one_decimal(agreement), F.lit("%")),
        F.lit("\n" + "=" * 60),
    )
    return joined.select("doc_id", text.alias("report"))


def audit_report(audited: DataFrame, mentions: DataFrame) -> DataFrame:
    """Text of the audit per document; the review list holds the first ten mentions. FIXED VALUES: wording."""
    joined = audited.join(low_confidence_first(mentions), "doc_id", "left")

    def count_pct(label: str, n: str) -> Column:
        return F.concat(F.lit(label), F.col(n).cast("string"), F.lit(" ("), one_decimal(100.0 * F.col(n) / F.col("total")), F.lit("%)"))

    problem_lines = F.transform("problems", lambda p, i: F.concat(
        F.lit("\n   "), (i + 1).cast("string"), F.lit(". ["), F.upper(p["severity"]), F.lit("] "), p["problem"],
        F.lit("\n      "), p["description"], F.lit("\n      → "), p["action"],
    ))
    review_lines = F.transform("review", lambda r: F.concat(
        F.lit("\n   "), r["n"].cast("string"), F.lit(". "), r["text"], F.lit(" (confianza: "), r["confidence"].cast("string"), F.lit("%)\n      Encontrado por: "), r["agent"],
    ))
    text = _lines(
        F.lit("=" * 80), F.lit("📊 INFORME DE AUDITORÍA DE REFERENCIAS LEGALES"), F.lit("=" * 80),
        F.concat(F.lit("\n"), F.col("emoji"), F.lit(" CALIFICACIÓN GLOBAL: "), F.col("grade").cast("string"), F.lit("/10 - "), F.col("level")),
        F.lit("\n📊 Factores:"),
        F.concat(F.lit("   - Confianza: "), F.col("confidence_factor").cast("string"), F.lit("/10")),
        F.concat(F.lit("   - Validación: "), F.col("validation_factor").cast("string"), F.lit("/10")),
        F.concat(F.lit("   - Cobertura: "), F.col("coverage_factor").cast("string"), F.lit("/10")),
        F.lit("\n📋 Resumen:"),
        F.concat(F.lit("   - Total referencias: "), F.col("total").cast("string")),
        F.lit("\n🎯 Confianza:"),
        F.concat(F.lit("   - Promedio: "), one_decimal(F.col("mean_confidence")), F.lit("%")),
        count_pct("   - Alta (≥90%): ", "high"), count_pct("   - Media (70-89%): ", "medium"), count_pct("   - Baja (<70%): ", "low"),
        F.lit("\n✅ Validación:"),
        F.concat(F.lit("   - Validadas: "), F.col("validated").cast("string"), F.lit("/"), F.col("total").cast("string"),
                 F.lit(" ("), one_decimal(100.0 * F.col("validated") / F.col("total")), F.lit("%)")),
        F.concat(F.lit("   - BOE-IDs encontrados: "), F.col("ids_found").cast("string")),
        F.lit("\n📈 Cobertura:"),
        F.concat(F.lit("   - Tipos encontrados: "), F.array_join("kinds", ", ")),
        F.concat(F.lit("   - Leyes: "), F.col("laws").cast("string")),
        F.concat(F.lit("   - Artículos: "), F.col("articles").cast("string")),
        F.when(F.size("problems") > 0, F.concat(
            F.lit("\n⚠️  Problemas Detectados: "), F.size("problems").cast("string"), F.lit("\n"), F.array_join(problem_lines, "\n"))),
        F.concat(F.lit("\n💡 Sugerencias:\n   "), F.array_join("suggestions", "\n   ")),
        F.when(F.col("review").isNotNull(), F.concat(
            F.lit("\n🔍 Referencias que Requieren Revisión Manual:\n"), F.array_join(review_lines, "\n"))),
        F.lit("\n" + "=" * 80),
    )
    return joined.select("doc_id", text.alias("report"))
