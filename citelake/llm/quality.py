"""Quality rules: base rules on words and lines, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over ``BUCKETS`` hashed uni- and bigrams: the trusted target
(a bounded sample of rows labelled good) and the raw corpus (every document). A document's score is
its mean log ratio per n-gram, so length does not count, and it is kept iff the score reaches a fixed
threshold. Tokens for the n-grams are runs of letters and digits or runs of other visible signs.

Defined results: null and empty texts have no words, fail the base rules and score 0; labels that
contradict each other for one id are not trusted; rows with a null id are scored and never trusted;
repeated rows are scored one by one; without trusted rows every score is 0. Columns of the input other
than ``doc_id`` and ``text`` are not read here, and ``filter_quality`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm import words as W

BUCKETS = 1 << 14
TRUSTED = 20_000  # rows at most that the target multinomial is fitted on
STRENGTH = float(BUCKETS)  # n-grams that the raw corpus counts for in the target: few trusted rows decide little
THRESHOLD = -0.3  # mean log ratio (nats) below which a document is rejected

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)


def _buckets(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every hashed unigram and bigram."""
    tokens = texts.tokens(W.PUNCT)
    pairs, at = W.grams(tokens, 2)
    mask = W.U(BUCKETS - 1)
    return (
        np.concatenate((tokens.hash & mask, pairs & mask)).astype(np.int64),
        np.concatenate((tokens.doc, tokens.doc[at])),
    )


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) over all n-grams of all texts; one dense vector leaves each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                total += np.bincount(_buckets(texts)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids labelled good and never bad; the first ``limit`` by hash."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw per bucket: ``BUCKETS`` numbers, whatever the corpus size."""
    target = docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels)), "doc_id", "left_semi")
    both = bucket_counts(docs).withColumn("side", F.lit(0)).union(bucket_counts(target).withColumn("side", F.lit(1)))
    counts = np.zeros((2, BUCKETS))
    for row in both.toLocalIterator():  # at most 2 * BUCKETS rows
        counts[row.side, row.bucket] = row.n
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw = (counts[0] + 1) / (counts[0].sum() + BUCKETS)
    target = (counts[1] + STRENGTH * raw) / (counts[1].sum() + STRENGTH)
    return np.log(target) - np.log(raw)


def _measures(texts: W.Texts) -> dict[str, np.ndarray]:
    rows = len(texts)
    words = texts.tokens()
    visible = W.WORD[texts.data].astype(bool)
    lines = texts.tokens(W.LINE)
    seen = np.concatenate(([0], np.cumsum(visible, dtype=np.int64)))
    full = seen[lines.end] > seen[lines.start]
    line_doc = lines.doc[full]
    _, distinct = W.per_doc(lines.hash[full], line_doc, rows)
    windows, at = W.grams(words, 3)
    ordered, bounds = W.sort_rows(windows, words.doc[at], rows)
    twin = np.zeros(len(ordered) + 1, bool)
    twin[1:-1] = ordered[1:] == ordered[:-1]
    twin[bounds[:-1][bounds[:-1] < len(ordered)]] = False
    total = np.concatenate(([0], np.cumsum(twin)))
    covered = np.zeros(len(words.doc) + 2, bool)
    for row in np.flatnonzero(total[bounds[1:]] > total[bounds[:-1]]).tolist():
        a, b = bounds[row], bounds[row + 1]
        hit = at[a:b][np.isin(windows[a:b], ordered[a:b][twin[a:b]])]
        for k in range(3):
            covered[hit + k] = True
    count = lambda doc: np.bincount(doc, minlength=rows)
    return {
        "n_words": count(words.doc),
        "word_chars": texts.count(visible & ((texts.data & 0xC0) != 0x80)),
        "n_symbols": texts.count(SYMBOLS[texts.data]),
        "n_dup_lines": count(line_doc) - count(distinct),
        "n_repeat_words": count(words.doc[covered[: len(words.doc)]]),
    }


MEASURES = [x.split()[0] for x in SCHEMA.split(", ")]


def score_documents(docs: DataFrame, carry: list[str], ratio: np.ndarray, threshold: float) -> DataFrame:
    """The columns ``carry`` as ``c0, c1, ...`` and all measures of ``text``; one pass, no shuffle.

    ``ratio`` has ``BUCKETS`` numbers and goes to the executors with the task.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                cols = _measures(texts)
                bucket, doc = _buckets(texts)
                n = np.bincount(doc, minlength=len(texts))
                cols["llr"] = np.bincount(doc, ratio[bucket], minlength=len(texts)) / np.maximum(n, 1)
                failed = (cols["n_words"] < 50) | (100 * cols["n_repeat_words"] > 50 * cols["n_words"])
                cols |= {"base_failed": failed, "kept": ~failed & (cols["llr"] >= threshold)}
                rows = [c.slice(texts.first, len(texts)) for c in batch.columns[1:]]
                values = [*rows, *(pa.array(cols[k]) for k in MEASURES)]
                yield pa.RecordBatch.from_arrays(values, [*(f"c{i}" for i in range(len(carry))), *MEASURES])

    columns = [F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(carry)]
    picked = docs.select(F.col("text").alias("__text"), *columns)
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in picked.schema.fields[1:])
    return picked.mapInArrow(score, schema + SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with base measures, ``llr`` and ``kept``, one row per row of ``docs``."""
    return score_documents(docs, ["doc_id"], fit_ratio(docs, labels), threshold).withColumnRenamed("c0", "doc_id")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    scored = score_documents(docs, docs.columns, fit_ratio(docs, labels), threshold).where("kept")
    return scored.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))
