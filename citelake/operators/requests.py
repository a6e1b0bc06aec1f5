"""Requests to an external extractor and its answers, as tables. No call is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.text import chunk_text, none_if_empty, request_key, rounded
from citelake.operators.extract import extract
from citelake.operators.resolve import batches
from citelake.schema import RESPONSE


def batch_requests(mentions: DataFrame, size: int, width: int, answered: DataFrame | None = None) -> DataFrame:
    """Resolution requests: ``size`` mentions of a document per request, numbered from 1.

    A request holds at most ``size`` lines. Requests whose key is in ``answered(request_key)`` are
    left out.
    """
    numbered = batches(mentions, size, width)
    line = F.concat(F.col("idx").cast("string"), F.lit(". "), F.col("text"), F.coalesce(F.concat(F.lit(" | "), F.col("law")), F.lit("")))
    grouped = numbered.groupBy("doc_id", "batch_id").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("body"),
    )
    keyed = grouped.withColumn("request_key", request_key("context", F.col("body")))
    return keyed if answered is None else keyed.join(answered.select("request_key"), "request_key", "left_anti")


def acronym_hints() -> str:
    """The acronyms that a request explains, each with its law, from the dictionary."""
    return "SIGLAS: " + "; ".join(f"{acronym} = {law}" for acronym, law in sorted(dims.acronym_laws().items()))


def extraction_requests(docs: DataFrame, previous: DataFrame, hints: str, size: int, overlap: int, known: int = 10) -> DataFrame:
    """Extraction requests: every chunk of a document with the mentions known so far and acronym hints.

    The whole text is asked about, in chunks. The list of known mentions shows the first ``known``
    and says when there are more.
    """
    order = W.partitionBy("doc_id").orderBy("start", "mention_id")
    first = previous.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= known + 1)
    shown = first.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("__n", "text"))).alias("__known")
    ).select(
        "doc_id",
        F.concat(
            F.array_join(F.transform(F.slice("__known", 1, known), lambda x: F.concat(F.lit("- "), x["text"])), "\n"),
            F.when(F.size("__known") > known, F.lit("\n... y más")).otherwise(F.lit("")),
        ).alias("known"),
    )
    chunks = docs.select("doc_id", F.inline(chunk_text(F.col("text"), size, overlap)))
    body = F.concat(
        F.col("chunk"), F.coalesce(F.concat(F.lit("\n\nREFERENCIAS YA ENCONTRADAS:\n"), F.col("known")), F.lit("")),
        F.lit("\n\n" + hints),
    )
    return chunks.join(shown, "doc_id", "left").select(
        "doc_id", "chunk_no", "start", F.length(body).alias("chars"), request_key("extract", body).alias("request_key")
    )


def response_json(raw: Column) -> Column:
    """The JSON of an answer: fenced, else the span around its ``referencias``, else all of it."""
    fenced = none_if_empty(F.regexp_extract(raw, r"(?s)```json\s*(\{.*\})\s*```", 1))
    span = none_if_empty(F.regexp_extract(raw, r'(?s)\{.*"referencias".*\}', 0))
    return F.coalesce(fenced, span, raw)


def parse_responses(responses: DataFrame, agent: str = "A") -> DataFrame:
    """Mentions of ``responses(doc_id, raw)``; broken answers go through the profile's patterns."""
    parsed = responses.withColumn("__refs", F.from_json(response_json(F.col("raw")), RESPONSE)["referencias"])
    good = parsed.where(F.col("__refs").isNotNull()).select("doc_id", F.posexplode("__refs").alias("idx", "r")).select(
        "doc_id",
        "idx",
        F.col("r.texto_completo").alias("text"),
        F.col("r.tipo").alias("kind"),
        F.col("r.ley").alias("law"),
        F.col("r.articulo").alias("article"),
        F.col("r.confianza").alias("confidence"),
        F.lit(False).alias("fallback"),
    )
    broken = parsed.where(F.col("__refs").isNull()).select("doc_id", F.col("raw").alias("text"))
    recovered = extract(broken, (agent,)).select(
        "doc_id", F.col("start").alias("idx"), "text", "kind", "law", "article", "confidence", F.lit(True).alias("fallback")
    )
    return good.unionByName(recovered)


def usage(calls: DataFrame) -> DataFrame:
    """Tokens, calls, errors and mean time per agent of ``calls(agent, prompt, ms, failed)``."""
    return calls.groupBy("agent").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.floor(F.length("prompt") / 4)).alias("tokens"),
        F.count_if("failed").alias("errors"),
        rounded(F.avg("ms"), 6).alias("mean_ms"),
    )
