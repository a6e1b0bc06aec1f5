"""Benchmark decontamination: BM25 over test items with block-max WAND, then an overlap check.

The index holds the test items; every training passage (``PASSAGE`` tokens, half overlapping) is a
query. An item is one entry of the index; an item of more than ``ENTRY`` tokens has, besides the whole,
entries of ``ENTRY`` tokens that overlap by half or more. An entry's term weights are its BM25 impacts
divided by their sum, so an entry found whole scores 1 and one threshold serves all. WAND skips entries
whose upper bounds cannot reach the threshold, and per-block maxima tighten the bounds; every item with an
entry at or above it is retrieved, with its best entry's score. Wherever a copy of an entry of ``ENTRY``
tokens begins, what the better of two neighbouring passages leaves out of it is at most half of its weight,
so a verbatim copy of an item of any length is retrieved. Most passages are settled before that, for
whole runs of texts at once: an entry's weight in common terms is bounded, so a passage needs enough weight
in the other, essential terms.

A retrieved item counts as leaked if its question (all but the last sentence) and its answer (the last
sentence; of one sentence the last third) both overlap with the document around the passage.

The items are taken in blocks of at most ``BLOCK_BYTES`` of text; each block is one index, sent to the
executors as a broadcast, and one pass over the documents. Number, mean length and document frequencies are those of
all items, counted by Spark, so that an item's weights do not depend on how the items fall into blocks.

Defined results: null and empty texts match nothing; items without tokens are never found; items with
equal texts are all reported; an item of one or two tokens is compared token by token; repeated
documents are each reported; an empty table on either side gives no leak; documents without an id are reported with a null id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm import words as W
from citelake.llm.store import Scratch

PASSAGE = 64  # tokens
ENTRY = 48  # tokens; at most 3/4 of a passage
THRESHOLD = 0.5  # of an item's own score
OVERLAP = 0.6  # share of question and of answer n-grams that must be found
GRAM = 3  # tokens
K1, B = 1.2, 0.75
ASIDE = 0.6  # share of the threshold that terms may bring which are not looked up at first
BLOCK = 16  # postings under one maximum
BLOCK_BYTES = 8 << 20

SCHEMA = "item_id long, score double, question_overlap double, answer_overlap double, passage long"


def _ngrams(tokens: np.ndarray) -> set:
    """Runs of ``GRAM`` tokens, or the whole if shorter."""
    t = tokens.tolist()
    n = min(GRAM, len(t))
    return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if n else set()


def _share(wanted: set, there: np.ndarray) -> float:
    if not wanted:
        return 1.0
    n, t = len(next(iter(wanted))), there.tolist()
    found = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    return len(wanted & found) / len(wanted)


def _entries(tokens: np.ndarray) -> list[np.ndarray]:
    """The whole item and, if it is longer than ``ENTRY`` tokens, evenly spaced parts of that length."""
    beyond = len(tokens) - ENTRY
    if beyond <= 0:
        return [tokens]
    starts = np.linspace(0, beyond, -(-beyond // (ENTRY // 2)) + 1).astype(np.int64).tolist()
    return [tokens, *(tokens[i : i + ENTRY] for i in starts)]


class Index:
    """Inverted index of one block of items, with block maxima.

    ``figures``: number of items with tokens, their mean length, and items by token; those of the block if not given.
    """

    def __init__(
        self,
        items: list[tuple[int, str]],
        threshold: float = THRESHOLD,
        figures: tuple[int, float, dict[int, int]] | None = None,
    ):
        self.threshold = threshold - 1e-9
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0))
        rows: list[tuple[int, np.ndarray, int]] = []
        column = pa.array([text or "" for _, text in items], pa.string())
        for texts in W.runs(column):
            tokens = texts.tokens(W.ALNUM, W.LOWER)
            bounds = np.searchsorted(tokens.doc, np.arange(len(texts) + 1))
            for r in range(len(texts)):
                a, b = bounds[r], bounds[r + 1]
                if b > a:
                    body = texts.data[texts.offsets[r] : texts.offsets[r + 1]].tobytes()
                    stops = [i for i in range(len(body) - 1) if body[i : i + 1] in b".!?\n"]
                    cut = 0
                    for stop in reversed(stops):
                        cut = int(np.searchsorted(tokens.start[a:b], texts.offsets[r] + stop))
                        if 0 < cut < b - a:
                            break
                    if not 0 < cut < b - a:
                        cut = (b - a) - (b - a) // 3
                    rows.append((items[texts.first + r][0], tokens.hash[a:b], cut))
        self.ids = [r[0] for r in rows]
        self.length = np.array([len(r[1]) for r in rows], np.int64)
        self.question = [_ngrams(r[1][: r[2]]) for r in rows]
        self.answer = [_ngrams(r[1][r[2] :]) for r in rows]
        self._weigh([r[1] for r in rows], figures)

    def _weigh(self, rows: list[np.ndarray], figures) -> None:
        here: dict[int, int] = defaultdict(int)
        for r in rows:
            for t in np.unique(r).tolist():
                here[t] += 1
        n, mean, df = figures or (len(rows), float(self.length.mean()) if len(rows) else 1.0, here)
        entries = [(item, e) for item, r in enumerate(rows) for e in _entries(r)]
        self.item = [item for item, _ in entries]  # of each entry
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        common_first = sorted(here, key=lambda t: (-here[t], t))
        for entry, (_, tokens) in enumerate(entries):
            terms, tf = np.unique(tokens, return_counts=True)
            k = K1 * (1 - B + B * len(tokens) / mean)
            impact = {
                t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + k)
                for t, f in zip(terms.tolist(), tf.tolist())
            }
            total = sum(impact.values())
            for t, v in impact.items():
                postings[t].append((entry, v / total))
        # Terms by falling document frequency are set aside while no entry has too much weight in them.
        essential = set(here)
        spent = np.zeros(len(entries))
        for t in common_first:
            grown = [(entry, spent[entry] + v) for entry, v in postings[t]]
            if max(v for _, v in grown) >= self.threshold * ASIDE:
                break
            for entry, v in grown:
                spent[entry] = v
            essential.discard(t)
        self.needed = self.threshold - spent - 1e-9  # weight that essential terms must bring, by entry
        self.postings = {
            t: (
                [i for i, _ in p],
                [v for _, v in p],
                [max(v for _, v in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)],
                max(v for _, v in p),
            )
            for t, p in postings.items()
        }
        self.vocabulary = np.array(sorted(self.postings), W.U)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary >> W.U(44)).astype(np.int64)] = True
        flat = [self.postings[t] if t in essential else ([], []) for t in self.vocabulary.tolist()]
        self.many = np.array([len(p[0]) for p in flat], np.int64)
        self.begin = np.cumsum(self.many) - self.many
        self.flat_entry = np.array([i for p in flat for i in p[0]], np.int64)
        self.flat_weight = np.array([v for p in flat for v in p[1]])

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All entries whose score over the distinct ``terms`` reaches the threshold: block-max WAND."""
        lists = [self.postings[t] for t in terms]
        at = [0] * len(lists)
        end = len(self.item)
        head = lambda k: lists[k][0][at[k]] if at[k] < len(lists[k][0]) else end

        def seek(k: int, entry: int) -> None:
            where = lists[k][0]
            while at[k] < len(where) and where[at[k]] < entry:
                at[k] += 1

        live, out = list(range(len(lists))), []
        while True:
            live = sorted((k for k in live if at[k] < len(lists[k][0])), key=head)
            bound, pivot = 0.0, None
            for p, k in enumerate(live):
                bound += lists[k][3]
                if bound >= self.threshold:
                    pivot = p
                    break
            if pivot is None:
                return out
            entry = head(live[pivot])
            while pivot + 1 < len(live) and head(live[pivot + 1]) == entry:
                pivot += 1
            ahead, beyond, tight = live[: pivot + 1], end, 0.0
            for k in ahead:  # block that would hold the entry
                where = lists[k][0]
                i = at[k] // BLOCK
                while (i + 1) * BLOCK < len(where) and where[(i + 1) * BLOCK] <= entry:
                    i += 1
                tight += lists[k][2][i]
                beyond = min(beyond, where[(i + 1) * BLOCK] if (i + 1) * BLOCK < len(where) else end)
            if tight < self.threshold:
                after = min(beyond, head(live[pivot + 1]) if pivot + 1 < len(live) else end)
                for k in ahead:
                    seek(k, max(after, entry + 1))
            elif head(ahead[0]) == entry:
                score = sum(lists[k][1][at[k]] for k in ahead)
                if score >= self.threshold:
                    out.append((entry, score))
                for k in ahead:
                    at[k] += 1
            else:
                for k in ahead:
                    seek(k, entry)

    def leaks(self, texts: W.Texts, overlap: float) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(row, item, score, question overlap, answer overlap, passage) of verified items.

        Every retrieved passage counts; reported is the verified one with the highest score, then the first.
        """
        tokens = texts.tokens(W.ALNUM, W.LOWER)
        n = len(tokens.hash)
        if not n or not len(self.vocabulary):
            return
        maybe = np.flatnonzero(self.filter[(tokens.hash >> W.U(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, tokens.hash[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == tokens.hash[maybe]
        hit = np.zeros(n, bool)
        hit[maybe[known]] = True
        starts = np.searchsorted(tokens.doc, np.arange(len(texts) + 1))
        half = PASSAGE // 2
        halves = -(-np.diff(starts) // half)
        first_half = np.cumsum(halves) - halves
        low, high, row, number = self._open(tokens, maybe[known], place[known], starts, first_half, halves)
        found: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)  # passages and their scores
        for p in range(len(low)):
            span = slice(low[p], high[p])
            terms = np.unique(tokens.hash[span][hit[span]]).tolist()
            for entry, score in self.search(terms):
                scores = found[int(row[p]), self.item[entry]]
                scores[p] = max(score, scores.get(p, 0.0))
        for (r, item), scores in sorted(found.items()):
            reach = int(self.length[item])
            for p, score in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
                there = tokens.hash[max(low[p] - reach, starts[r]) : min(high[p] + reach, starts[r + 1])]
                question, answer = _share(self.question[item], there), _share(self.answer[item], there)
                if min(question, answer) >= overlap:
                    yield r, item, score, question, answer, int(number[p])
                    break

    def _open(self, tokens, at, term, starts, first_half, halves):
        """Passages in which some entry's essential weight may suffice: bounds, row and number.

        Weights are summed per (half passage, entry), repeats included, for the whole run of texts.
        """
        half, entries = PASSAGE // 2, len(self.item)
        many = self.many[term]
        where = np.repeat(self.begin[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        doc = tokens.doc[at]
        of = np.repeat(first_half[doc] + (at - starts[doc]) // half, many)
        key = of * entries + self.flat_entry[where]
        order = np.argsort(key)
        key, weight = key[order], self.flat_weight[where][order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        cut = np.flatnonzero(new)
        key, total = key[cut], np.add.reduceat(weight, cut) if len(cut) else weight
        after = np.minimum(np.searchsorted(key, key + entries), max(len(key) - 1, 0))
        both = total + np.where(key[after] == key + entries, total[after], 0.0) if len(key) else total
        needed = self.needed[key % entries]
        at_half = np.concatenate((key[both >= needed] // entries, key[total >= needed] // entries - 1))
        # A half before a row's first belongs to another row; its passage is then looked at in vain.
        at_half = np.unique(at_half[at_half >= 0])
        row = np.searchsorted(first_half, at_half, "right") - 1
        number = np.minimum(at_half - first_half[row], np.maximum(halves[row] - 2, 0))
        row, number = np.unique(np.stack((row, number), 1), axis=0).T if len(row) else (row, number)
        low = starts[row] + number * half
        return low, np.minimum(low + PASSAGE, starts[row + 1]), row, number


def _tokens(items: DataFrame) -> DataFrame:
    """(block, length, token) of the distinct tokens of every item; the first of an item carries its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                tokens = texts.tokens(W.ALNUM, W.LOWER)
                pairs = np.unique(np.stack((tokens.doc.astype(np.int64), tokens.hash.view(np.int64)), 1), axis=0)
                first = np.ones(len(pairs), bool)
                first[1:] = pairs[1:, 0] != pairs[:-1, 0]
                length = np.bincount(tokens.doc, minlength=len(texts))[pairs[:, 0]]
                block = batch.column(1).slice(texts.first, len(texts)).take(pa.array(pairs[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [block, pa.array(np.where(first, length, 0), pa.int64()), pa.array(pairs[:, 1], pa.int64())],
                    ["block", "length", "token"],
                )

    return items.select("text", "block").mapInArrow(run, "block long, length long, token long")


def indexes(items: DataFrame, threshold: float = THRESHOLD) -> Iterator[Index]:
    """One index per block of items; a block is at most about ``BLOCK_BYTES`` of text on the driver."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    if blocks == 1:  # the block's own figures are those of all items
        yield Index([(r.item_id, r.text) for r in items.toLocalIterator()], threshold)
        return
    scratch = Scratch(items.sparkSession)
    tokens = scratch.put(_tokens(items))
    n, length = tokens.agg(F.count_if(F.col("length") > 0), F.sum("length")).first()
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    of_block = scratch.put(tokens.select("block", "token").distinct().join(df, "token"))
    scratch.drop(tokens)
    for k in range(blocks):
        known = {r.token % (1 << 64): r.df for r in of_block.where(F.col("block") == k).toLocalIterator()}
        part = items.where(F.col("block") == k)
        yield Index([(r.item_id, r.text) for r in part.toLocalIterator()], threshold, (n, (length or 0) / max(n, 1), known))
    scratch.drop(of_block)


def _scan(docs: DataFrame, index: Index, overlap: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                found = list(index.leaks(texts, overlap))
                if found:
                    rows, item, *rest = zip(*found)
                    ids = batch.column(1).slice(texts.first, len(texts)).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([index.ids[i] for i in item], pa.int64()), *map(pa.array, rest)],
                        ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))],
                    )

    return docs.select("text", "doc_id").mapInArrow(scan, f"doc_id long, {SCHEMA}")


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id) of every leak, with its best verified passage, score and overlaps. No shuffle."""
    out = None
    for index in indexes(items, threshold):
        part = _scan(docs, index, overlap)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item leaked; one pass for each block."""

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for texts in W.runs(batch.column(0)):
                    good = np.ones(len(texts), bool)
                    good[[row for row, *_ in index.leaks(texts, overlap)]] = False
                    rows = [c.slice(texts.first, len(texts)) for c in batch.columns[1:]]
                    yield pa.RecordBatch.from_arrays(rows, batch.schema.names[1:]).filter(pa.array(good))

        return run

    for index in indexes(items, threshold):
        columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
        picked = docs.select(F.col("text").alias("__text"), *columns)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = picked.mapInArrow(keep(shared), schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return docs
