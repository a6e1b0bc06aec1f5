"""Places of mentions that came without an offset."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTED = 1000  # texts looked for in one pass over a document


def lower_alike(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def loose_pattern(mention: str) -> re.Pattern:
    """The mention in any case, with optional dots and any white space for a space."""
    parts = (r"\.?" if c == "." else r"\s+" if c == " " else re.escape(c) for c in mention)
    return re.compile("".join(parts), re.IGNORECASE)


def places(text: str, mentions: list[str]) -> list[int]:
    """0-based place of the first occurrence of each mention, -1 where there is none.

    One automaton of all mentions walks the text once; only mentions that do not occur as written are then
    looked for one by one in their loose form.
    """
    low = lower_alike(text)
    automaton, by_text = ahocorasick.Automaton(), {}
    for i, mention in enumerate(mentions):
        by_text.setdefault(lower_alike(mention), []).append(i)
    out = [-1] * len(mentions)
    for word in by_text:
        if word:
            automaton.add_word(word, word)
    if len(automaton):
        automaton.make_automaton()
        missing = len(automaton)
        for end, word in automaton.iter(low):
            if out[by_text[word][0]] < 0:
                for i in by_text[word]:
                    out[i] = end - len(word) + 1
                missing -= 1
                if not missing:
                    break
    for i, mention in enumerate(mentions):
        if out[i] < 0 and mention.strip(". "):
            hit = loose_pattern(mention).search(text)
            out[i] = hit.start() if hit else -1
    return out


def context(text: str, place: int, window: int) -> str | None:
    """Up to ``window`` characters on both sides of a place, dots where the text goes on."""
    if place < 0:
        return None
    begin, end = max(place - window, 0), min(len(text), place + window)
    return ("..." if begin else "") + text[begin:end] + ("..." if end < len(text) else "")


def locate(docs: DataFrame, mentions: DataFrame, window: int = 1500) -> DataFrame:
    """Distinct mentions (doc_id, text) with their 1-based ``place`` in ``docs(doc_id, text)``, 0 if absent, and context.

    As written in any case first, else with loose dots and spaces. The distinct mentions of a document are
    brought to its text in lists of about ``LISTED``, so the text is moved once per list and never per mention. Mentions of
    documents that are not in ``docs`` and null texts are left out; an empty mention is absent.
    """
    wanted = mentions.where("text is not null").select("doc_id", F.col("text").alias("mention")).distinct()
    sizes = wanted.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("lists"))
    dealt = wanted.join(sizes, "doc_id").withColumn("list", F.pmod(F.xxhash64("mention"), F.col("lists")))
    lists = dealt.groupBy("doc_id", "list").agg(F.sort_array(F.collect_list("mention")).alias("mentions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one document and list at a time
                text, mentions = batch.column(0)[i].as_py() or "", batch.column(1)[i].as_py()
                found = places(text, mentions)
                columns = [
                    batch.column(2).slice(i, 1).take(pa.array([0] * len(mentions), pa.int32())),
                    pa.array(mentions, pa.string()),
                    pa.array([p + 1 for p in found], pa.int32()),
                    pa.array([context(text, p, window) for p in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "place", "context"])

    rows = docs.select("doc_id", "text").join(lists, "doc_id").select("text", "mentions", "doc_id")
    return rows.mapInArrow(search, f"doc_id {kind}, text string, place int, context string")
