"""Ranked lexical search of many items at once, by common-subexpression evaluation.

The score of an item is a sum over its terms, and a term's part is the same for every item that holds it.
Term sets that several items share are mined by merging, again and again, the two accumulators that most
items have in common. What results is a graph: terms at the bottom, shared sets above them, items on top.
Every document is read once for the statistics and once for the scores; for a run of documents each
accumulator of the graph is filled once, from the two below it, and items add up the few accumulators that
are left to them. Tasks keep the best rows of each item, which are then ranked in two steps, by item and a
residue of the document and by item.

Items are worked on in blocks of a bounded number of terms; the statistics are those of all documents, so
blocks do not change results. Terms are 64-bit hashes of their bytes.

Defined results: null, empty and termless texts are no documents and items without rows; rows with one
item_id are one item with the terms of all; rows of documents are ranked one by one, so a repeated row takes
as many ranks as it occurs; a null doc_id comes after all others of its score; empty tables give no rows.
Texts of any length are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm import words as W

BEST = 50  # rows of an item
BLOCK = 1 << 16  # terms of the items of one block, repeats counted
AT_ONCE = 16  # blocks evaluated in one pass over the documents
MINED = 32  # terms among which pairs are looked for; longer items are mined in such pieces
CELLS = 1 << 21  # accumulators of a graph times documents evaluated together
HELD = 1 << 18  # rows a task holds before it keeps the best
RESIDUES = 16


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item, as hashes."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                tokens = texts.tokens(W.ALNUM, W.LOWER)
                hashes, row = W.per_doc(tokens.hash, tokens.doc, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row + texts.first)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("text", "item_id").mapInArrow(terms, f"item_id {kind}, term long").distinct()


class Graph:
    """Accumulators of a block of items: ``terms`` first, then sums of two earlier ones.

    ``levels`` are (node, left, right) arrays whose inputs lie in earlier levels; item ``i`` adds up
    ``tops[bounds[i]:bounds[i + 1]]``.
    """

    def __init__(self, items: list[np.ndarray]):
        self.terms, flat = np.unique(np.concatenate(items), return_inverse=True)
        cuts = np.cumsum([0] + [len(t) for t in items])
        shared = np.bincount(flat, minlength=len(self.terms))
        pieces, owner = [], []
        for i in range(len(items)):
            own = flat[cuts[i] : cuts[i + 1]]
            own = own[np.lexsort((own, -shared[own]))].tolist()
            for k in range(0, len(own), MINED):
                pieces.append(set(own[k : k + MINED]))
                owner.append(i)
        merges = self._mine(pieces, len(self.terms), shared)
        depth = dict.fromkeys(range(len(self.terms)), 0)
        by_level = defaultdict(list)
        for node, (a, b) in enumerate(merges, len(self.terms)):
            depth[node] = 1 + max(depth[a], depth[b])
            by_level[depth[node]].append((node, a, b))
        self.levels = [tuple(np.array(x) for x in zip(*by_level[d])) for d in sorted(by_level)]
        self.nodes = len(self.terms) + len(merges)
        tops: list[list[int]] = [[] for _ in items]
        for i, piece in zip(owner, pieces):
            tops[i] += sorted(piece)
        self.tops = np.array([t for top in tops for t in top], np.int64)
        self.bounds = np.cumsum([0] + [len(t) for t in tops])

    @staticmethod
    def _mine(pieces: list[set], nodes: int, shared: np.ndarray) -> list[tuple[int, int]]:
        """Merge the pair that most pieces hold until no two pieces share one; ``pieces`` are changed."""
        where = defaultdict(set)
        counts: Counter = Counter()
        for i, piece in enumerate(pieces):
            often = sorted(t for t in piece if shared[t] > 1)
            for t in often:
                where[t].add(i)
            counts.update((a, b) for k, a in enumerate(often) for b in often[k + 1 :])
        heap = [(-n, pair) for pair, n in counts.items() if n > 1]
        heapq.heapify(heap)
        merges: list[tuple[int, int]] = []
        while heap:
            n, (a, b) = heapq.heappop(heap)
            both = where[a] & where[b]
            if len(both) < 2:
                continue
            if len(both) < -n:  # some of its pieces have merged a or b since
                heapq.heappush(heap, (-len(both), (a, b)))
                continue
            node = nodes + len(merges)
            merges.append((a, b))
            fresh: Counter = Counter()
            for i in both:
                pieces[i] -= {a, b}
                fresh.update(x for x in pieces[i] if i in where[x])
                pieces[i].add(node)
            where[a] -= both
            where[b] -= both
            where[node] = set(both)
            for x, m in fresh.items():
                if m > 1:
                    heapq.heappush(heap, (-m, (x, node)))
        return merges

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Scores (items, documents) from the parts (terms, documents) of the terms."""
        filled = np.empty((self.nodes, parts.shape[1]), np.int64)
        filled[: len(self.terms)] = parts
        for node, a, b in self.levels:
            filled[node] = filled[a] + filled[b]
        return np.add.reduceat(filled[self.tops], self.bounds[:-1], axis=0)


def corpus_statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each of ``terms`` (sorted hashes)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        held = np.zeros(len(known), np.int64)
        n = total = 0
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                at, doc, sizes = _known(texts, known)
                n += int((sizes > 0).sum())
                total += int(sizes.sum())
                held += np.bincount(np.unique(doc * len(known) + at) % len(known), minlength=len(known))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-2, -1], some))), pa.array(np.concatenate(([n, total], held[some])))], ["term", "c"]
        )

    rows = docs.select("text").mapInArrow(count, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).toPandas()
    held = np.zeros(len(terms) + 2, np.int64)
    held[rows["term"].to_numpy() + 2] = rows["c"].to_numpy()  # as many rows as the block has terms
    sent.unpersist()
    return int(held[0]), int(held[1]), held[2:]


def _known(texts: W.Texts, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of ``terms`` (place, row), and the number of all terms of each row."""
    tokens = texts.tokens(W.ALNUM, W.LOWER)
    at = np.minimum(np.searchsorted(terms, tokens.hash), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == tokens.hash)
    return at[hit], tokens.doc[hit], np.bincount(tokens.doc, minlength=len(texts))


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1))).astype(np.int64)


class _Best:
    """The best rows of each item that a task has met: (item, score, doc, whether doc is null)."""

    def __init__(self, items: int, k: int):
        self.k, self.items, self.held, self.size = k, items, [], 0
        self.least = np.ones(items, np.int64)  # a row below it is not among the best

    def add(self, first: int, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, col = np.nonzero(scores >= self.least[first : first + len(scores), None])
        self.held.append((item + first, scores[item, col], doc[col], null[col]))
        self.size += len(item)
        if self.size > HELD:
            self.keep()

    def keep(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 4
        rows = [np.concatenate(x) for x in zip(*self.held)]
        order = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        item = rows[0][order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = order[place == self.k - 1]
        self.least[rows[0][last]] = rows[1][last]
        rows = tuple(x[order[place < self.k]] for x in rows)
        self.held, self.size = [rows], len(rows[0])
        return rows


def _search(docs: DataFrame, terms: np.ndarray, graphs: list[Graph], statistics: tuple[int, int, np.ndarray], k: int) -> DataFrame:
    """(item, doc_id, score): the best rows of each item in each task; items are numbered through ``graphs``."""
    documents, total, held = statistics
    sent = docs.sparkSession.sparkContext.broadcast((terms, weights(documents, held), [(g, np.searchsorted(terms, g.terms)) for g in graphs]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, blocks = sent.value
        best = _Best(sum(len(g.bounds) - 1 for g, _ in blocks), k)
        widest = max(g.nodes + len(g.tops) for g, _ in blocks)
        step = max(1, CELLS // widest)
        for batch in batches:
            ids = batch.column(1)
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            for texts in W.runs(batch.column(0)):
                at, doc, sizes = _known(texts, known)
                met, tf = np.unique(doc * len(known) + at, return_counts=True)
                doc, at = met // len(known), met % len(known)
                m = 100 - 50 + (50 * sizes * documents) // max(total, 1)
                part = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                for low in range(0, len(texts), step):
                    high = min(low + step, len(texts))
                    a, b = np.searchsorted(doc, (low, high))
                    dense = np.zeros((len(known), high - low), np.int64)
                    dense[at[a:b], doc[a:b] - low] = part[a:b]
                    rows = slice(texts.first + low, texts.first + high)
                    first = 0
                    for graph, own in blocks:
                        best.add(first, graph.scores(dense[own]), ids[rows], null[rows])
                        first += len(graph.bounds) - 1
        item, points, doc, null = best.keep()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int64)), pa.array(doc.astype(np.int64), mask=null.astype(bool)), pa.array(points.astype(np.int64))],
            ["item", "doc_id", "score"],
        )

    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(score, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each item."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    terms = item_terms(items)
    blocks = max(1, -(-terms.count() // block))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = items.schema["item_id"].dataType.simpleString()
    parts = []
    for low in range(0, blocks, AT_ONCE):  # a bounded number of terms at a time
        rows = terms.where((F.col("block") >= low) & (F.col("block") < low + AT_ONCE)).toArrow()
        own: dict = defaultdict(lambda: defaultdict(list))
        for item, term, b in zip(*(rows.column(c).to_pylist() for c in ("item_id", "term", "block"))):
            own[b][item].append(term)
        named = [[*own[b]] for b in sorted(own)]
        if not named:
            continue
        graphs = [Graph([np.array(own[b][i], np.int64).view(W.U) for i in ids]) for b, ids in zip(sorted(own), named)]
        all_terms = np.unique(np.concatenate([g.terms for g in graphs]))
        found = _search(docs, all_terms, graphs, corpus_statistics(docs, all_terms), k)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(i for ids in named for i in ids)], f"item long, item_id {kind}")
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        for keys in (["item", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(RESIDUES))], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        parts.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
