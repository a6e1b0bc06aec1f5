"""Topic documents: nested JSON, broken JSON, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.functions.text import none_if_empty
from citelake.schema import TOPIC


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, with the file it came from."""
    raw = spark.read.schema(TOPIC).option("multiLine", True).json(path)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("document.documentVersion.contenido").alias("html"),
    )


def topic_html(raw: Column) -> Column:
    """HTML inside a topic's JSON text."""
    return F.from_json(raw, TOPIC)["document"]["documentVersion"]["contenido"]


def rescue_topics(raw: DataFrame) -> DataFrame:
    """HTML of ``raw(…, json)``: parsed, else cut out of the broken JSON, else its heading span.

    ``rescued`` names the way that worked; rows where none did have no HTML and belong in quarantine.
    """
    parsed = topic_html(F.col("json"))
    field = none_if_empty(F.regexp_extract("json", r'(?s)"contenido"\s*:\s*"(.+)"', 1))
    heading = none_if_empty(F.regexp_extract("json", r"(?s)<h1[^>]*>.*</h1>", 0))
    return raw.withColumn("html", F.coalesce(parsed, field, heading)).withColumn(
        "rescued",
        F.when(parsed.isNotNull(), F.lit("json"))
        .when(field.isNotNull(), F.lit("field"))
        .when(heading.isNotNull(), F.lit("heading"))
        .otherwise(F.lit("none")),
    )


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def read_text(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Text and Markdown files, decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", decode_text(F.col("content")).alias("text"))


def text_to_html(name: Column, text: Column) -> Column:
    """A topic page from plain text: blank lines part paragraphs, single line ends become breaks."""
    trimmed = F.transform(F.split(text, "\n\n", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    paragraphs = F.transform(
        F.filter(trimmed, lambda p: p != ""),
        lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")),
    )
    return F.concat(
        F.lit('<div class="documento-estudiante">\n<h1>'), name, F.lit("</h1>\n"),
        F.array_join(paragraphs, ""), F.lit("\n</div>"),
    )


def topic_json(html: Column) -> Column:
    """A topic's JSON text around its HTML."""
    return F.to_json(F.struct(F.struct(F.struct(html.alias("contenido")).alias("documentVersion")).alias("document")))
