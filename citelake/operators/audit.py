"""Quality scoring of documents: everything follows from one aggregate row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelake.functions.text import rounded
from citelake.operators.ordered import number_rows

HIGH, MEDIUM = 90, 70
LAW_KINDS = ("ley", "real_decreto", "sigla")


def _conf() -> Column:
    return F.coalesce("confidence", F.lit(0))


def _validated() -> Column:
    return F.coalesce("validated", F.lit(False))


def confidence_columns() -> list[Column]:
    conf, total = _conf(), F.count(F.lit(1))
    high, low = F.count_if(conf >= HIGH), F.count_if(conf < MEDIUM)
    medium = F.count_if((conf >= MEDIUM) & (conf < HIGH))
    return [
        total.alias("total"),
        rounded(F.avg(conf), 6).alias("mean_confidence"),
        F.min(conf).alias("min_confidence"),
        F.max(conf).alias("max_confidence"),
        high.alias("high"),
        medium.alias("medium"),
        low.alias("low"),
        rounded(100.0 * high / total, 6).alias("high_pct"),
        rounded(100.0 * medium / total, 6).alias("medium_pct"),
        rounded(100.0 * low / total, 6).alias("low_pct"),
    ]


def validation_columns() -> list[Column]:
    ok, total = F.count_if(_validated()), F.count(F.lit(1))
    return [
        ok.alias("validated"),
        (total - ok).alias("not_validated"),
        rounded(ok / total, 6).alias("rate"),
        rounded(100.0 * ok / total, 6).alias("validated_pct"),
        F.count_if(F.coalesce(F.col("boe_id") != "", F.lit(False))).alias("ids_found"),
    ]


def coverage_columns() -> list[Column]:
    laws = F.count_if(F.col("kind").isin(*LAW_KINDS))
    articles = F.count_if(F.col("kind") == "articulo")
    return [
        laws.alias("laws"),
        articles.alias("articles"),
        F.when(articles > 0, rounded(laws / articles, 6)).otherwise(F.lit(float("inf"))).alias("law_article_ratio"),
    ]


def audit_confidence(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("doc_id").agg(*confidence_columns())


def audit_validation(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("doc_id").agg(*validation_columns())


def audit_coverage(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("doc_id").agg(*coverage_columns())


def coverage_cube(mentions: DataFrame) -> DataFrame:
    """Mentions per document and kind, per document and agent, and per document, in one pass."""
    return mentions.groupingSets(
        [["doc_id", "kind"], ["doc_id", "agent"], ["doc_id"]], "doc_id", "kind", "agent"
    ).agg(F.count(F.lit(1)).alias("mentions"))


def profile(mentions: DataFrame) -> DataFrame:
    """All that problems, suggestions and grade need. Kinds are few by contract, texts are not:
    their distinct count is taken over (doc, text) before the documents are formed."""
    return mentions.groupBy("doc_id").agg(
        *confidence_columns(),
        *validation_columns(),
        *coverage_columns(),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        (F.count(F.lit(1)) - F.countDistinct(F.coalesce("text", F.lit("")))).alias("duplicates"),
    )


def one_decimal(c: Column) -> Column:
    return rounded(c, 1).cast("string")


def _rule(severity: str, name: str, condition: Column, description: Column, action: str) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(severity).alias("severity"), F.lit(name).alias("problem"),
            description.alias("description"), F.lit(action).alias("action"),
        ),
    )


def problems(converged: Column | None = None) -> Column:
    """Array of problems of a profile row. FIXED VALUES: names, severities and wording."""
    total = F.col("total")
    rules = [
        _rule(
            "alta", "validacion_baja", F.col("validated") / total < 0.5,
            F.concat(F.lit("Tasa de validación muy baja: "), one_decimal(100.0 * F.col("validated") / total), F.lit("% (esperado >50%)")),
            "Revisar manualmente las referencias no validadas o expandir el mapeo de leyes",
        ),
        _rule(
            "media", "confianza_baja", F.col("low") > total * 0.3,
            F.concat(F.col("low").cast("string"), F.lit(" referencias con confianza <70% ("), one_decimal(100.0 * F.col("low") / total), F.lit("%)")),
            "Revisar manualmente las referencias de baja confianza",
        ),
    ]
    if converged is not None:
        rules.append(_rule(
            "media", "sin_convergencia", ~F.coalesce(converged, F.lit(False)),
            F.lit("No se alcanzó convergencia en las rondas permitidas"),
            "Considerar aumentar el número máximo de rondas o revisar el texto",
        ))
    rules += [
        _rule(
            "alta", "pocas_referencias", total < 5,
            F.concat(F.lit("Solo se encontraron "), total.cast("string"), F.lit(" referencias")),
            "El tema puede tener pocas referencias legales o los agentes necesitan ajuste",
        ),
        _rule(
            "baja", "duplicados", F.col("duplicates") > 0,
            F.concat(F.col("duplicates").cast("string"), F.lit(" referencias duplicadas detectadas")),
            "Revisar el filtrado de duplicados en el sistema de convergencia",
        ),
    ]
    return F.array_compact(F.array(*rules))


def suggestions() -> Column:
    """Array of suggestions of a profile row that holds ``problems``. FIXED VALUES: the wording."""
    rules = F.array_compact(F.array(
        F.when(F.col("mean_confidence") < MEDIUM,
               F.lit("⚠️ Confianza promedio baja - Considerar revisar manualmente todas las referencias")),
        F.when(F.col("low") > 0,
               F.concat(F.lit("🔍 "), F.col("low").cast("string"), F.lit(" referencias requieren revisión manual"))),
        F.when(F.col("rate") < 0.7,
               F.lit("📝 Expandir el mapeo de leyes comunes en el BOESearcher para mejorar validación")),
        F.when(F.col("not_validated") > 0,
               F.concat(F.lit("✅ Validar manualmente "), F.col("not_validated").cast("string"), F.lit(" referencias contra el BOE"))),
        F.when((F.col("articles") == 0) & (F.col("laws") > 0),
               F.lit("🎯 Solo se encontraron leyes, sin artículos específicos - Tema puede ser muy general")),
        F.when(F.exists("problems", lambda p: p["severity"] == "alta"),
               F.lit("⚠️ Se detectaron problemas de severidad ALTA - Revisión urgente recomendada")),
    ))
    fine = F.array(F.lit("✅ La extracción parece correcta - Revisión manual opcional"))
    return F.when(F.size(rules) > 0, rules).otherwise(fine)


def grade_columns() -> list[Column]:
    """Grade 0-10 and its factors. FIXED VALUES: weights, bounds and level names."""
    by_confidence = F.col("mean_confidence") / 10
    by_validation = F.col("rate") * 10
    by_coverage = F.least(F.size("kinds"), F.lit(5)) * 2
    note = by_confidence * 0.4 + by_validation * 0.4 + by_coverage * 0.2
    level = (
        F.when(note >= 8, F.lit("Excelente"))
        .when(note >= 6, F.lit("Bueno"))
        .when(note >= 4, F.lit("Aceptable"))
        .otherwise(F.lit("Requiere Revisión"))
    )
    emoji = F.when(note >= 8, F.lit("🌟")).when(note >= 6, F.lit("✅")).when(note >= 4, F.lit("⚠️")).otherwise(F.lit("❌"))
    return [
        rounded(rounded(note, 6), 1).alias("grade"),
        level.alias("level"),
        emoji.alias("emoji"),
        rounded(by_confidence, 1).alias("confidence_factor"),
        rounded(by_validation, 1).alias("validation_factor"),
        rounded(by_coverage.cast("double"), 1).alias("coverage_factor"),
    ]


def audit(mentions: DataFrame, convergence: DataFrame | None = None) -> DataFrame:
    """The audit table: profile, problems, suggestions and grade, one row per document.

    ``convergence(doc_id, converged)`` adds the rule on rounds that did not converge.
    """
    rows = profile(mentions)
    flag = None
    if convergence is not None:
        rows = rows.join(convergence.select("doc_id", "converged"), "doc_id", "left")
        flag = F.col("converged")
    rows = rows.withColumn("problems", problems(flag))
    return rows.select("*", suggestions().alias("suggestions"), *grade_columns())


def audit_problems(mentions: DataFrame, convergence: DataFrame | None = None) -> DataFrame:
    return audit(mentions, convergence).select("doc_id", F.inline("problems"))


def audit_suggestions(mentions: DataFrame, convergence: DataFrame | None = None) -> DataFrame:
    return audit(mentions, convergence).select("doc_id", F.posexplode("suggestions").alias("n", "suggestion"))


def audit_grade(mentions: DataFrame) -> DataFrame:
    return profile(mentions).select("doc_id", *grade_columns())


def review(mentions: DataFrame, width: int) -> DataFrame:
    """All mentions that need a review, numbered within their document."""
    low = mentions.where(_conf() < MEDIUM).withColumn("confidence", _conf())
    return number_rows(low, ["doc_id"], "start", "seq", width, ("mention_id",)).select("doc_id", "seq", "mention_id", "text", "confidence", "agent")


def low_confidence_first(mentions: DataFrame, k: int = 10) -> DataFrame:
    """The first k mentions of each document that need a review, as one short array per document;
    ``review`` has all of them as rows."""
    low = mentions.where(_conf() < MEDIUM)
    order = W.partitionBy("doc_id").orderBy("start", "mention_id")
    first = low.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    return first.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("__n").alias("n"), F.col("text"), _conf().alias("confidence"), F.col("agent"),
        ))).alias("review")
    )
