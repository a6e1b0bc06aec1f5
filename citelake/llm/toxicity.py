"""Toxicity by non-negative positive-unlabelled learning.

Positives are rows confirmed toxic, the rest is unlabelled text; both come from the learning fold
(crc32 of the id modulo 3 is not 1) and are bounded choices by hash (``POSITIVE``, ``UNLABELLED``). A
document's features are the distinct words (letters and digits, lower case) and word beginnings it holds,
hashed; those over-represented among positives are selected. Logistic classifiers are trained in numpy on
the risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the second part turns negative, its
gradient is reversed. The prior is the toxic share of the labelled rows of the learning fold. A score is
the mean of the members' probabilities.

Defined results: null and empty texts get the score of a document without features; rows with a null id
are scored, never held out and never learned from; an id labelled toxic by any row is toxic and is learned
from the smallest of its texts; without
positives every score is 0. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm import words as W
from citelake.llm.store import Scratch

POSITIVE = 4_000
UNLABELLED = 8_000
FEATURES = 1_024
LEAST = 5  # positives that a feature must occur in
BEGINNINGS = (4, 5, 6)  # bytes
MEMBERS = 3
STEPS = 300
DECAY = 1e-5
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id", mod: int = 3, at: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == at, F.lit(False))


def features(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each row, and their rows."""
    tokens = texts.tokens(W.ALNUM, W.LOWER)
    hashes, docs = [tokens.hash], [tokens.doc]
    for n in BEGINNINGS:
        long = tokens.end - tokens.start > n
        start = tokens.start[long]
        hashes.append(W.mix(texts._hashes(start, start + n, W.LOWER) + W.U(n)))
        docs.append(tokens.doc[long])
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return W.per_doc(np.concatenate(hashes)[order], doc[order], len(texts))


def choose(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, positive) of the documents to learn from, at most ``POSITIVE + UNLABELLED`` distinct ones; and the
    prior. An id counts once however often it occurs, and labels without a document are no examples."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    positive = known.where("toxic = 1").join(ids, "doc_id", "left_semi").select("doc_id").orderBy(*order).limit(POSITIVE)
    free = ids.orderBy(*order).limit(UNLABELLED)
    return positive.withColumn("positive", F.lit(1)).unionByName(free.withColumn("positive", F.lit(0))), float(prior)


def _scan(rows: DataFrame, body, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                yield body(texts, batch.column(1).slice(texts.first, len(texts)))

    return rows.mapInArrow(run, schema)


def _counts(texts: W.Texts, positive: pa.Array) -> pa.RecordBatch:
    hashes, doc = features(texts)
    side = np.asarray(positive)[doc]
    keys, back = np.unique(hashes, return_inverse=True)
    p = np.bincount(back, side, len(keys)).astype(np.int64)
    n = np.bincount(back, minlength=len(keys))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(p), pa.array(n - p)], ["f", "p", "u"])


class Model:
    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        order = np.argsort(names)
        self.names, self.weights, self.bias = names[order], weights[:, order], bias
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.names >> W.U(48)).astype(np.int64)] = True

    def find(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Selected features of each row: (index of the feature, row)."""
        hashes, doc = features(texts)
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> W.U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.names, hashes[maybe]), len(self.names) - 1)
        real = self.names[at] == hashes[maybe]
        return at[real], doc[maybe[real]]

    def score(self, texts: W.Texts) -> np.ndarray:
        if not len(self.bias):
            return np.zeros(len(texts))
        col, row = self.find(texts)
        z = [b + np.bincount(row, w[col], len(texts)) for w, b in zip(self.weights, self.bias)]
        return np.mean([1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z], axis=0)


def train(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier on sparse 0/1 rows, by the non-negative risk."""
    rng = np.random.default_rng(seed)
    use = np.where(positive, 1.0, rng.random(len(positive)) < 0.8)
    share = np.where(positive, use / max(positive.sum(), 1), use / max((use * ~positive).sum(), 1))
    w, b = np.zeros(n), 0.0
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, w[cols], len(positive))
        up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)
        unlabelled, taken = (share * soft)[~positive].sum(), (share * soft)[positive].sum()
        over = np.where(positive, -prior * share * up, share * up)  # of R_u(-) - prior R_p(-)
        if unlabelled - prior * taken >= 0:
            g = np.where(positive, prior * share * (up - 1), 0.0) + over
        else:
            g = -over
        grad = np.append(np.bincount(cols, g[rows], n) + DECAY * w, g.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:n], b - move[n]
    return w, b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifiers. The driver holds ``FEATURES`` names and the selected features of the chosen rows."""
    chosen, prior = choose(docs, labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text of each id: an id may hold a third of all rows
    rows = Scratch(docs.sparkSession).put(rows.groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("text", "positive", "doc_id"))
    size = {r.positive: r.n for r in rows.groupBy("positive").agg(F.count("*").alias("n")).toLocalIterator()}
    np_, nu = size.get(1, 0), size.get(0, 0)
    if not np_ or not nu:
        return Model(np.zeros(0, W.U), np.zeros((0, 0)), np.zeros(0))
    counts = _scan(rows, _counts, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    base = (F.col("u") + F.col("p")) / F.lit(float(np_ + nu))
    z = (F.col("p") / np_ - F.col("u") / nu) / F.sqrt(base * (1.0 / np_ + 1.0 / nu))
    best = counts.where(F.col("p") >= min(LEAST, np_)).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "f").limit(FEATURES)
    names = np.sort(np.array([r.f for r in best.select("f").toLocalIterator()], np.int64).view(W.U))
    blank = Model(names, np.zeros((0, len(names))), np.zeros(0))

    def select(texts: W.Texts, positive: pa.Array) -> pa.RecordBatch:
        col, row = blank.find(texts)
        order = np.argsort(row, kind="stable")
        found = W.lists(col[order].astype(np.int32), row[order], len(texts), pa.int32())
        return pa.RecordBatch.from_arrays([positive, found], ["positive", "found"])

    data = _scan(rows, select, "positive int, found array<int>").toPandas()
    data = data.assign(key=data["found"].map(lambda x: tuple(sorted(x)))).sort_values(["positive", "key"])
    lengths = data["found"].map(len).to_numpy()
    row = np.repeat(np.arange(len(data)), lengths)
    col = np.concatenate([np.asarray(x, np.int64) for x in data["key"]]) if len(data) else np.zeros(0, np.int64)
    col = col.astype(np.int64)
    members = [train(row, col, data["positive"].to_numpy() == 1, len(names), prior, seed) for seed in range(MEMBERS)]
    return Model(names, np.array([w for w, _ in members]).reshape(MEMBERS, len(names)), np.array([b for _, b in members]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``. Scoring is one pass, no shuffle."""
    model = fit(docs, labels)

    def score(texts: W.Texts, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(model.score(texts))], ["doc_id", "score"])

    scored = _scan(docs.select("text", "doc_id"), score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
