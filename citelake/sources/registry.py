"""Registry payloads: law index, search results, article blocks, EU metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.functions.text import none_if_empty

_INDEX = "id STRING, titulo STRING, fecha_actualizacion STRING"
_SEARCH = "data STRUCT<item: ARRAY<STRUCT<identificador: STRING, titulo: STRING>>>"
_BLOCK = (
    "status STRUCT<code: STRING>, data STRUCT<bloque: STRUCT<_titulo: STRING,"
    " version: ARRAY<STRUCT<p: ARRAY<STRING>>>>>"
)
_EU_VALUE = "STRUCT<value: STRING>"
_EU_META = (
    f"results STRUCT<bindings: ARRAY<STRUCT<work: {_EU_VALUE}, titulo_es: {_EU_VALUE}, fecha: {_EU_VALUE}, tipo: {_EU_VALUE}>>>"
)


def read_law_index(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of law-index XML files that have both an id and a title."""
    raw = spark.read.format("xml").option("rowTag", "bloque").schema(_INDEX).load(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("id"), F.col("titulo"), F.col("fecha_actualizacion"))
    return _titled(rows)


def parse_law_index(payloads: DataFrame, xml: str = "xml") -> DataFrame:
    """Blocks of index payloads held in a column, one block per payload element, in order."""
    parsed = F.from_xml(F.col(xml), f"bloque ARRAY<STRUCT<{_struct(_INDEX)}>>")
    return _titled(payloads.select("*", F.posexplode(parsed["bloque"]).alias("block_no", "__b")).select(
        *[c for c in payloads.columns if c != xml], "block_no", "__b.*"
    ))


def _struct(fields: str) -> str:
    return fields.replace(" STRING", ": STRING")


def _titled(rows: DataFrame) -> DataFrame:
    has_both = (F.coalesce(F.trim("id"), F.lit("")) != "") & (F.coalesce(F.trim("titulo"), F.lit("")) != "")
    return rows.where(has_both).withColumn("id", F.trim("id")).withColumn("titulo", F.trim("titulo"))


def pick_registry_id(payload: Column, kind: Column) -> Column:
    """Id of the first search item with a valid id whose title fits the wanted type of norm."""
    items = F.from_xml(payload, _SEARCH)["data"]["item"]
    wanted = F.lower(F.trim(kind))
    word = F.when(wanted.isin("ley", "ley orgánica"), F.lit("ley")).when(
        wanted.isin("real decreto", "rd", "real decreto legislativo", "rdl"), F.lit("real decreto")
    )

    def fits(item: Column) -> Column:
        title = F.lower(F.coalesce(item["titulo"], F.lit("")))
        valid = F.coalesce(F.trim(item["identificador"]).rlike(r"^BOE-[A-Z]-\d{4}-\d+"), F.lit(False))
        return valid & ((title == "") | word.isNull() | title.contains(F.coalesce(word, F.lit(""))))

    return F.trim(F.get(F.filter(items, fits), F.lit(0))["identificador"])


def parse_article_block(payload: Column) -> Column:
    """Title and newest text of an article block; null unless the payload's code is 200."""
    parsed = F.from_xml(payload, _BLOCK)
    first = F.get(parsed["data"]["bloque"]["version"], F.lit(0))
    return F.when(
        (parsed["status"]["code"] == "200") & first.isNotNull(),
        F.struct(parsed["data"]["bloque"]["_titulo"].alias("title"), F.array_join(first["p"], "\n").alias("body")),
    )


def parse_eu_metadata(payload: Column) -> Column:
    """First binding of a metadata answer; ``exists`` is false when there is none."""
    first = F.get(F.from_json(payload, _EU_META)["results"]["bindings"], F.lit(0))
    return F.struct(
        first.isNotNull().alias("exists"),
        first["work"]["value"].alias("work_uri"),
        none_if_empty(first["titulo_es"]["value"]).alias("title"),
        first["fecha"]["value"].alias("date"),
        first["tipo"]["value"].alias("type"),
    )
