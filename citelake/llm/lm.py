"""Katz backoff language model: Good-Turing discounted bigrams over unigrams over one unknown word.

Counts. The tokens of a block of documents (``BLOCK`` rows of one input partition) are reduced to its
distinct bigrams with their training counts, packed as arrays by range of the history's hash. Each range is
one group: it adds the counts of all blocks, writes its part of the model tables (``unigrams``: word,
count; ``bigrams``: history, word, count), asks the ranges of words for the unigram counts of its distinct
successors, and answers every block with
the counts it asked for. A frequent word sends one entry per block, not one per occurrence. Every bigram seen
in training is stored (``LEAST`` = 1), packed by history; counts are packed at 7 bits a byte, of any size.

Weights. For a stored bigram P(w|h) = d(c) c(hw) / c(h), with Good-Turing discounts d for counts up to
``TOP``. A history's backoff weight is (1 - sum of these) / (1 - sum of the unigram P of the same words),
so that P(.|h) sums to 1 exactly over the vocabulary and the unknown word. Unigrams are discounted alike
and leave their mass to the unknown word. Where nothing is left, one is added to the denominator.

Evaluation is recursive per token: the bigram if stored, else backoff weight times the unigram, else times
the unknown word. The answers meet the documents by block, in the order of the requests.

Defined results: null and empty texts consist of the end token; rows with a null id are learned from and
not held out; repeated rows count each; without training rows every token has probability 1 / (V + 1) = 1.
Words are told apart by 64-bit hashes, the
successors of one history by 48 bits of them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm import words as W
from citelake.llm.store import Scratch, steady_splits

BLOCK = 12  # bits: rows of one input partition that form a block
RANGE_BYTES = 12 << 20  # text bytes per range of histories
LEAST = 1  # bigrams seen less often are left to the backoff: none
PART = 1 << 20  # bigrams in one row of the model
TOP = 5  # counts above are not discounted
WORD_BYTES = 6  # of a successor's hash that are sent
SHORT = (1 << 8 * WORD_BYTES) - 1
START, END = W.mix(np.array([11, 12], W.U))

REQUEST = "bucket long, block long, h binary, run binary, w binary, n binary"
STATS = [f"{x}{r}" for x in "ub" for r in range(1, TOP + 2)] + ["tokens", "words", "docs"]
COUNTED = "kind string, bucket long, block long, h binary, at binary, ch binary, chw binary, run binary, w binary, n binary, " + ", ".join(f"{s} long" for s in STATS)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(mod: int = 7, at: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == at, F.lit(False))


class Block:
    """Distinct bigrams of a block, sorted by history and word."""

    def __init__(self, texts: list[pa.Array], train: np.ndarray):
        hist, word, doc, first = [], [], [], 0
        for column in texts:
            for run in W.runs(column):
                t = run.tokens(W.WORD, W.LOWER)
                n, m = len(t.hash), len(run)
                count = np.bincount(t.doc, minlength=m)
                at = np.arange(n) + t.doc  # a slot more per document before
                h, w = np.full(n + m, START, W.U), np.full(n + m, END, W.U)
                w[at], h[at + 1] = t.hash, t.hash
                h[np.cumsum(count + 1) - count - 1] = START
                hist.append(h)
                word.append(w)
                doc.append(np.repeat(np.arange(first, first + m), count + 1))
                first += m
        empty = np.zeros(0, W.U)
        h, w = np.concatenate(hist or [empty]), np.concatenate(word or [empty])
        self.doc = np.concatenate(doc or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.lexsort((w & W.U(SHORT), h))
        hs, ws = h[order], w[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])
        self.pair = np.empty(len(hs), np.int64)  # of each token: its bigram
        self.pair[order] = np.cumsum(new) - 1
        cut = np.flatnonzero(new)
        self.h, self.w = hs[cut], ws[cut]
        self.n = np.add.reduceat(train[self.doc[order]].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)
        self.names, self.begin, self.run = np.unique(self.h, return_index=True, return_counts=True)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> W.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def requests(rows: DataFrame, bits: int) -> DataFrame:
    """Packed distinct bigrams of every block, one row per range that it touches."""

    def pack(block: int, parts: list, flags: list) -> Iterator[pa.RecordBatch]:
        b = Block(parts, np.concatenate(flags))
        of = _bucket(b.names, bits)
        keys, first = np.unique(of, return_index=True)
        ends = np.append(first[1:], len(of))
        out = []
        for key, i, j in zip(keys.tolist(), first.tolist(), ends.tolist()):
            x, y = b.begin[i], (b.begin[j] if j < len(b.begin) else len(b.h))
            out.append({
                "bucket": key, "block": block, "h": b.names[i:j].tobytes(), "run": _pack(b.run[i:j]),
                "w": _short(b.w[x:y]), "n": _pack(b.n[x:y]),
            })
            if len(out) == 64:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, flags = None, [], []
        for batch in batches:
            blocks = np.asarray(batch.column(2))
            cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)).tolist() + [len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if parts and blocks[a] != now:
                    yield from pack(now, parts, flags)
                    parts, flags = [], []
                now = int(blocks[a])
                parts.append(batch.column(0).slice(a, b - a))
                flags.append(~np.asarray(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), bool))
        if parts:
            yield from pack(now, parts, flags)

    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("h", "run", "w", "n"))])
    return rows.select("text", "held_out", "block").mapInArrow(run, REQUEST)


def _short(w: np.ndarray) -> bytes:
    """The low ``WORD_BYTES`` of each hash: enough to tell the successors of one history apart."""
    return np.ascontiguousarray(w.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()


def _whole(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, WORD_BYTES)
    return out.view(W.U).ravel()


def _pack(counts: np.ndarray) -> bytes:
    """Their number, then the low 7 bits of each with a mark if more follow, then the next 7 of those marked."""
    c = counts.astype(W.U)
    out = [np.array([len(c)], np.int64).tobytes()]
    while len(c):
        more = c > W.U(127)
        out.append((c & W.U(127) | more.astype(W.U) << W.U(7)).astype(np.uint8).tobytes())
        c = c[more] >> W.U(7)
    return b"".join(out)


def _unpack(packed: bytes) -> np.ndarray:
    n, at, shift = int(np.frombuffer(packed, np.int64, 1)[0]), 8, 0
    out, of = np.zeros(n, np.int64), np.arange(n)
    while len(of):
        part = np.frombuffer(packed, np.uint8, len(of), at).astype(np.int64)
        out[of] |= (part & 127) << shift
        at, shift, of = at + len(of), shift + 7, of[part > 127]
    return out


def _join(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _counts(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [_unpack(x) for x in column.to_pylist()]


def _view(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _places(stored: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Twice the place of each history among the stored ones, and one more if it is there: in rising order."""
    at = np.searchsorted(stored, own)
    there = stored[np.minimum(at, len(stored) - 1)] == own if len(stored) else np.zeros(len(own), bool)
    return 2 * at + there


def _by_words(kind: str, words: np.ndarray, bits: int, counts: np.ndarray | None = None) -> Iterator[dict]:
    """A row for each range of words, given their sorted short hashes."""
    of = (words >> W.U(8 * WORD_BYTES - bits)).astype(np.int64)
    keys, first = np.unique(of, return_index=True)
    for key, i, j in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), len(of)]):
        yield {"kind": kind, "block": key, "w": _short(words[i:j])} | ({} if counts is None else {"n": _pack(counts[i:j])})


def count_range(group: pa.Table, word_bits: int) -> pa.Table:
    """One range of histories: model rows, statistics, an answer for each block, and the successors
    whose unigram counts it wants."""
    names, runs = _view(group["h"], W.U), [x.astype(np.int32) for x in _counts(group["run"])]
    words, counts = [_whole(x) for x in group["w"].to_pylist()], [x.astype(np.int32) for x in _counts(group["n"])]
    h = np.concatenate([np.repeat(a, b) for a, b in zip(names, runs)])
    w, n = np.concatenate(words), np.concatenate(counts)
    order = np.lexsort((w, h))
    h, w, n = h[order], w[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    cut = np.flatnonzero(new)
    total = np.add.reduceat(n, cut, dtype=np.int64)
    back = np.empty(len(h), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    h, w = h[cut], w[cut]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    hist, ch = h[first], np.add.reduceat(total, first)
    kept = total >= LEAST
    stored = np.unique(h[kept])
    rows, at = [], 0
    for block, own in zip(group["block"].to_pylist(), names):
        size = int(runs[len(rows)].sum())
        rows.append({
            "kind": "answer", "block": block, "at": _pack(np.diff(_places(stored, own), prepend=0)),
            "ch": _pack(ch[np.searchsorted(hist, own)]), "chw": _pack(back[at : at + size]),
        })
        at += size
    word = np.where(hist == START, END, hist)  # as many documents end as start
    seen = ch > 0
    stats = {f"u{r}": int((ch[seen] == r).sum()) for r in range(1, TOP + 2)} | {f"b{r}": int((total == r).sum()) for r in range(1, TOP + 2)}
    stats |= {"tokens": int(ch.sum()), "words": int(seen.sum()), "docs": int(ch[hist == START].sum())}
    rows.append({"kind": "stats", **stats})
    own = word[seen] & W.U(SHORT)
    order = np.argsort(own)
    rows += _by_words("unigrams", own[order], word_bits, ch[seen][order])
    h, w, total = h[kept], w[kept], total[kept]
    rows += _by_words("wanted", np.unique(w), word_bits)
    for x in range(0, len(h), PART):
        part = slice(x, x + PART)
        own, run = np.unique(h[part], return_counts=True)
        rows.append({"kind": "bigrams", "block": x // PART, "h": own.tobytes(), "run": _pack(run), "w": _short(w[part]), "n": _pack(total[part])})
    bucket = group["bucket"][0].as_py()
    fields = []
    for field in COUNTED.split(", "):
        name, kind = field.split(" ")
        fields.append((name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]))
    return pa.Table.from_pylist([{"bucket": bucket, **r} for r in rows], schema=pa.schema(fields))


class Weights:
    """Discounts and totals of the model: a few numbers."""

    def __init__(self, stats: dict[str, int]):
        self.docs, self.tokens, self.words = stats["docs"], stats["tokens"], stats["words"]
        self.uni = self._discounts([stats[f"u{r}"] for r in range(1, TOP + 2)], 1)
        self.bi = self._discounts([stats[f"b{r}"] for r in range(1, TOP + 2)], LEAST)
        mass = sum((1 - self.uni[r - 1]) * r * stats[f"u{r}"] for r in range(1, TOP + 1))
        self.total = self.tokens if mass > 1e-9 else self.tokens + 1
        self.unknown = max(mass, 1.0) / self.total if mass <= 1e-9 else mass / self.total

    @staticmethod
    def _discounts(n: list[int], least: int) -> list[float]:
        """Good-Turing ratios for 1..TOP; 1/2 less than the count where these are not between 0 and 1."""
        a = (TOP + 1) * n[TOP] / n[0] if n[0] else 1.0
        out = []
        for r in range(1, TOP + 1):
            d = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) if n[r - 1] and a < 1 else 0.0
            out.append(d if 0 < d < 1 else (r - 0.5) / r)
        return out

    def unigram(self, c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.uni, 1.0])[np.minimum(c, TOP + 1)]
        return np.where(c > 0, d * c / self.total, self.unknown)

    def bigram(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.array([0.0, *self.bi, 1.0])[np.minimum(c, TOP + 1)] * c


def _look_up(wanted: pa.Table, unigrams: pa.Table) -> pa.Table:
    """One range of words: the unigram counts that each range of histories wants, in the order of its request."""
    w, c = _join([_whole(x) for x in unigrams["w"].to_pylist()], W.U), _join(_counts(unigrams["n"]))
    order = np.lexsort((c, w))
    w, c = w[order], c[order]
    last = np.append(w[1:] != w[:-1], True)[: len(w)]
    w, c = w[last], c[last]
    out = [_pack(c[np.searchsorted(w, _whole(x))]) for x in wanted["w"].to_pylist()]
    return pa.table({"bucket": wanted["bucket"], "block": wanted["block"], "n": pa.array(out, pa.binary())})


def _backoff(model: pa.Table, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """For each stored history the discounted counts of its successors, and the unigram mass of these."""
    model = model.sort_by("block")
    is_reply = np.array([x is None for x in model["w"].to_pylist()], bool)
    pairs, replies = model.filter(pa.array(~is_reply)), model.filter(pa.array(is_reply))
    h = _join([np.repeat(a, b) for a, b in zip(_view(pairs["h"], W.U), _counts(pairs["run"]))], W.U)
    w, c, cw = _join([_whole(x) for x in pairs["w"].to_pylist()], W.U), _join(_counts(pairs["n"])), _join(_counts(replies["n"]))
    names, of = np.unique(w, return_inverse=True)
    if len(names) != len(cw):
        raise RuntimeError("unigram counts are missing")
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    if not len(first):
        return np.zeros(0), np.zeros(0)
    return np.add.reduceat(weights.bigram(c), first), np.add.reduceat(weights.unigram(cw)[of], first)


def _attach(weights: Weights):
    """Backoff weight and denominator of every history that a block asked for."""

    def run(answers: pa.Table, model: pa.Table) -> pa.Table:
        mass, low = _backoff(model, weights)
        more, alpha = [], []
        for at, ch in zip(_counts(answers["at"]), _counts(answers["ch"])):
            place = np.cumsum(at)
            hit = place % 2 == 1
            plus, a = np.zeros(len(ch), np.int8), np.ones(len(ch))
            m, u = mass[place[hit] // 2], low[place[hit] // 2]
            plus[hit] = m >= ch[hit] - 1e-9
            a[hit] = (1 - m / (ch[hit] + plus[hit])) / (1 - u)
            more.append(plus.tobytes())
            alpha.append(a.tobytes())
        return pa.table({
            "bucket": answers["bucket"], "block": answers["block"], "more": pa.array(more, pa.binary()), "alpha": pa.array(alpha, pa.binary()),
        })

    return run


def _evaluate(weights: Weights):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("id")
        held = np.asarray(docs["held_out"].to_numpy(), bool)
        b = Block(docs["text"].chunks, ~held)
        answers = answers.sort_by("bucket")
        counts, backs = (answers.filter(pc.is_valid(answers[c])) for c in ("ch", "alpha"))
        ch, chw = _join(_counts(counts["ch"])), _join(_counts(counts["chw"]))
        more, alpha = _join(_view(backs["more"], np.int8)), _join(_view(backs["alpha"], np.float64))
        den = ch + more
        if not len(ch) == len(alpha) == len(b.names) or len(chw) != len(b.h):
            raise RuntimeError("a block changed between two reads of the documents")
        of_h = np.repeat(np.arange(len(b.names)), b.run)
        at = np.minimum(np.searchsorted(b.names, b.w), len(b.names) - 1)
        cw = np.where(b.w == END, weights.docs, ch[at])
        base = np.log10((cw + 1) / (weights.tokens + weights.words + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            stored = np.log10(weights.bigram(chw) / den[of_h])
        score = np.where(chw >= LEAST, stored, np.log10(alpha[of_h]) + np.log10(weights.unigram(cw)))
        sum_ = lambda v: np.bincount(b.doc, v[b.pair], len(docs))
        rows = len(docs)
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(np.bincount(b.doc, minlength=rows)),
            "n_known": pa.array(sum_((cw > 0).astype(float)).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, weights.tokens)), "base_score": pa.array(sum_(base)), "score": pa.array(sum_(score)),
        })

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of ``docs``
    (a stored table: its rows are read twice and keep their partitions)."""
    scratch = Scratch(docs.sparkSession)
    steady_splits(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(size // RANGE_BYTES).bit_length())
    word_bits = max(4, bits - 4)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"), F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumn("block", F.shiftright("id", BLOCK))
    counted = scratch.put(requests(rows, bits).groupBy("bucket").applyInArrow(lambda group: count_range(group, word_bits), COUNTED), by=["kind"])
    stats = counted.where("kind = 'stats'").agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS)).first().asDict()
    weights = Weights(stats)
    # Aliases: the two sides of a cogroup may not have columns in common.
    part = lambda kind, *columns: counted.where(F.col("kind") == kind).select(*(F.col(c).alias(c) for c in columns))
    wanted, words = part("wanted", "bucket", "block", "w"), part("unigrams", "block", "w", "n")
    replies = wanted.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_look_up, "bucket long, block long, n binary")
    model = part("bigrams", "bucket", "block", "h", "run", "w", "n").unionByName(replies, allowMissingColumns=True)
    answers = part("answer", "bucket", "block", "at", "ch")
    backs = answers.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(
        _attach(weights), "bucket long, block long, more binary, alpha binary"
    )
    full = part("answer", "bucket", "block", "ch", "chw").unionByName(backs, allowMissingColumns=True)
    return rows.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(_evaluate(weights), SCORES)
