"""Spelling variants: words one code point apart, by bidirectional FM-index search schemes.

The vocabulary is cut into buckets that hold all words sharing the first (side 0) or the last (side 1)
letters of a word, so that a word and its near words meet in a bucket of one side. A bucket is one
delimited text with suffix ranks in both directions. Side 0 matches the first half of a word exactly,
outwards from its last letter to the delimiter, and extends right across the second half allowing one
error; side 1 does the same mirrored. An error lies in one half or the other, and side 1 leaves out words
that keep the first half, so each ordered pair of near words is found once; only counts and the best
partner of each word leave the bucket, never pairs.

Defined results: null, empty and wordless texts give no words, an empty table an empty result; a null
doc_id counts as an empty string in the deletion hash; repeated rows count as often as they occur; a run
of any length is one word; ties go to the smallest word in code-point order. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm import words as W
from citelake.llm.store import Scratch

LEAST = 7  # code points of a word
EVERY = 31  # a run whose hash this divides loses a code point
TIMES = 10  # a form is at least so many times as frequent
BUCKET = 1 << 14  # words of an index, about
CHUNK = 1 << 13  # queries searched at once


def crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = crc_table()


def letter_runs(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0..U+00FF: byte start, byte end, row, code points."""
    data, n = texts.data, len(texts.data)
    low = data | 0x20
    lead = data == 0xC3  # all of U+00C0..U+00FF and nothing else begins with this byte
    letter = ((low >= 97) & (low <= 122) & (data < 128)) | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    flat = np.zeros(n + 1, bool)
    flat[:n] = letter
    before = np.zeros(n + 1, bool)
    before[1:] = letter
    start = np.flatnonzero(flat & (~before | edge))
    end = np.flatnonzero(before & (~flat | edge))
    row = np.searchsorted(texts.offsets, start, "right") - 1
    lead_run = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    return start, end, row, end - start - (lead_run[end] - lead_run[start])


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of a prefix (its value in ``first``) followed by the bytes of each run."""
    state = first ^ np.uint32(0xFFFFFFFF)
    live, k = np.arange(len(start)), 0
    while len(live):
        live = live[start[live] + k < end[live]]
        s = state[live]
        state[live] = _CRC[(s ^ data[start[live] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
        k += 1
    return state ^ np.uint32(0xFFFFFFFF)


def _bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at])).cast(pa.string())


def count_words(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n): lower-cased runs, some of them a code point short, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for texts in W.runs(batch.column(0), 8 << 20):
                start, end, row, points = letter_runs(texts)
                keep = points >= least
                start, end, row, points = start[keep], end[keep], row[keep], points[keep]
                data = W.LOWER[texts.data]
                heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[texts.first : texts.first + len(texts)]]
                h = run_hashes(data, start, end, np.array(heads, np.uint32)[row]) if len(start) else np.zeros(0, np.uint32)
                cut = np.flatnonzero((h % every == 0) & (points > least)).tolist()
                short = []
                for i in cut:
                    word = data[start[i] : end[i]].tobytes().decode()
                    at = int(h[i]) % len(word)
                    short.append(word[:at] + word[at + 1 :])
                whole = np.flatnonzero(h % every != 0)
                start, end = start[whole], end[whole]
                _, first, n = np.unique(W.Texts(data, texts.offsets, 0)._hashes(start, end, W.SAME), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_bytes(data, start[first], end[first]), pa.array(n)], ["word", "n"])
                if short:
                    yield pa.RecordBatch.from_arrays([pa.array(short), pa.array(np.ones(len(short), np.int64))], ["word", "n"])

    return docs.select("text", "doc_id").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Index:
    """Suffix ranks of delimited words in both directions.

    Symbols are places in ``alphabet``, the delimiter is 0, a letter that no word has is the last. ``less[0]`` is
    of the words, ``less[1]`` of the words reversed: ``less[d][i, c]`` counts the symbols below ``c`` among the
    first ``i`` of the transformed text. An interval is (first rank, first rank reversed, size).
    """

    def __init__(self, words: list[str]):
        """``words`` are distinct and sorted."""
        self.words = len(words)
        self.alphabet = np.unique(np.append(_points("".join(words)), 0).astype(np.uint32))
        self.less = []
        for listed in (words, sorted(w[::-1] for w in words)):
            text, _ = self.read(["", *listed])  # a delimiter before each word
            suffix = np.argsort(self._ranks(text))
            table = np.zeros((len(text) + 1, len(self.alphabet) + 2), np.int32)
            table[np.arange(1, len(text) + 1), text[suffix - 1] + 1] = 1
            np.cumsum(table, axis=1, out=table)
            np.cumsum(table, axis=0, out=table)
            if not self.less:
                self.word_of = (np.cumsum(text == 0) - 1)[suffix]
            self.less.append(table)
        self.first = self.less[0][-1].astype(np.int64)

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words with a delimiter between two, and the start of each word."""
        points = _points("\0".join(words))
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[at] == points, at, len(self.alphabet))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        return symbols, np.cumsum(sizes) - sizes

    @staticmethod
    def _ranks(text: np.ndarray) -> np.ndarray:
        """Rank of each suffix by prefix doubling; delimiters are told apart by their place, which is that of
        the sorted word after them."""
        places = np.cumsum(text == 0) - 1
        rank = np.where(text == 0, places, text + places[-1])
        step = 1
        while True:
            _, new = np.unique(rank * (int(rank.max()) + 1) + np.roll(rank, -step), return_inverse=True)
            if int(new.max()) == len(text) - 1:
                return new
            rank, step = new, step * 2

    def all(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.first[-1], np.int64)

    def extend(self, side: int, state: tuple, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals after one symbol more on the left (``side`` 0) or the right (1)."""
        here, other, size = (state[0], state[1], state[2]) if side == 0 else (state[1], state[0], state[2])
        less = self.less[side]
        a, a1, b, b1 = less[here, c], less[here, c + 1], less[here + size, c], less[here + size, c + 1]
        new = self.first[c] + (a1 - a)
        other = other + (b - a)
        size = ((b1 - b) - (a1 - a)).astype(np.int64)
        return (new, other, size) if side == 0 else (other, new, size)

    def follow(self, side: int, state: tuple) -> np.ndarray:
        """Per interval and symbol, whether the symbol occurs next on ``side``; the delimiter does not count."""
        here, size = state[side], state[2]
        counts = np.diff(self.less[side][here + size] - self.less[side][here], axis=1) > 0
        counts[:, 0] = False
        return counts


def _pick(state: tuple, at: np.ndarray) -> tuple:
    return state[0][at], state[1][at], state[2][at]


def one_error(index: Index, side: int, letters: np.ndarray, start: np.ndarray, size: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): words one error away, the error within the half that lies towards ``side``.

    Query ``i`` is ``letters[start[i]:start[i] + size[i]]``, read in the direction of the search (reversed for
    side 0); its first ``half[i]`` symbols are matched exactly, from the last of them outwards to the delimiter.
    """
    q = np.arange(len(start))
    state = index.all(len(q))
    step = 1
    while True:  # the exact half, against the direction of the search
        more = half[q] >= step
        if not more.any():
            break
        c = np.zeros(len(q), np.int64)
        c[more] = letters[start[q[more]] + half[q[more]] - step]
        grown = index.extend(1 - side, state, c)
        state = tuple(np.where(more, g, s) for g, s in zip(grown, state))
        keep = state[2] > 0
        q, state, step = q[keep], _pick(state, np.flatnonzero(keep)), step + 1
    state = index.extend(1 - side, state, np.zeros(len(q), np.int64))
    keep = np.flatnonzero(state[2] > 0)
    q, state = q[keep], _pick(state, keep)
    at = half[q]
    wrong: list[tuple] = []
    while len(q):
        left = at < size[q]
        next_ = np.zeros(len(q), np.int64)
        next_[left] = letters[start[q[left]] + at[left]]
        row, c = np.nonzero(index.follow(side, state))
        child = index.extend(side, _pick(state, row), c)
        wrong.append((q[row], at[row], child))  # a letter more
        swap = np.flatnonzero(left[row] & (c != next_[row]))
        wrong.append((q[row[swap]], at[row[swap]] + 1, _pick(child, swap)))  # another letter
        some = np.flatnonzero(left)
        q, at, state, next_ = q[some], at[some] + 1, _pick(state, some), next_[some]
        wrong.append((q, at, state))  # a letter less
        state = index.extend(side, state, next_)
        keep = np.flatnonzero(state[2] > 0)
        q, at, state = q[keep], at[keep], _pick(state, keep)
    if not wrong:
        return q, q
    q = np.concatenate([w[0] for w in wrong])
    at = np.concatenate([w[1] for w in wrong])
    state = tuple(np.concatenate([w[2][k] for w in wrong]) for k in range(3))
    done_q, done_w = [], []
    while len(q):  # the rest exactly, then the delimiter
        left = at < size[q]
        c = np.zeros(len(q), np.int64)
        c[left] = letters[start[q[left]] + at[left]]
        state = index.extend(side, state, c)
        ended = np.flatnonzero(~left & (state[2] > 0))
        done_q.append(q[ended])
        # from the left delimiter, the interval of a whole word is one suffix of the words' direction
        done_w.append(index.word_of[state[0][ended]])
        keep = np.flatnonzero(left & (state[2] > 0))
        q, at, state = q[keep], at[keep] + 1, _pick(state, keep)
    found = np.unique(np.concatenate(done_q) * np.int64(index.words + 1) + np.concatenate(done_w)) if done_q else np.zeros(0, np.int64)
    return found // (index.words + 1), found % (index.words + 1)


def search_bucket(side: int, entries: list[str], counts: np.ndarray, queries: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """(query, near words, largest count, its word) of the queries that have near words among ``entries``.

    Entries of side 0 share their beginnings with the queries, and the search runs right; on side 1 they share
    their endings, and it runs left.
    """
    if not entries:
        return
    order = sorted(range(len(entries)), key=entries.__getitem__)
    entries, counts = [entries[i] for i in order], counts[order]
    index = Index(entries)
    for k in range(0, len(queries), CHUNK):
        part = queries[k : k + CHUNK]
        size = np.array([len(w) for w in part], np.int64)
        half = size // 2 if side == 0 else size - size // 2
        letters, at = index.read(part if side == 0 else [w[::-1] for w in part])
        q, v = one_error(index, 1 - side, letters, at, size, half)
        if side:  # pairs that keep the first half belong to side 0
            new = [not entries[b].startswith(part[a][: len(part[a]) // 2]) for a, b in zip(q.tolist(), v.tolist())]
            q, v = q[np.array(new, bool)], v[np.array(new, bool)]
        if not len(q):
            continue
        best = np.lexsort((v, -counts[v], q))
        q, v = q[best], v[best]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        for a, b, n in zip(q[first].tolist(), v[first].tolist(), np.diff(np.append(first, len(q))).tolist()):
            yield part[a], n, int(counts[b]), entries[b]


def _shared(side: int, length: Column) -> Column:
    """The letters that a word shares with each near word of ``length`` on this side."""
    k = F.floor((length - 1) / 2).cast("int")
    return F.substring("word", F.lit(1), k) if side == 0 else F.substring("word", F.length("word") - k + 1, k)


def near_words(vocabulary: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, form_n, form): of words that have near words, their number and the most frequent one.

    ``vocabulary`` (word, n) is a written table of distinct words of two code points or more. A word is an entry
    of the buckets of its own beginning and ending, and a query of those that words one shorter, as long, and one
    longer have with the same letters. Beginnings shared by more than ``bucket`` words are cut into parts, and
    their queries go to each part.
    """
    total = vocabulary.count()
    size = F.length("word")
    sides, tasks = [], max(1, -(-total // bucket))
    for side in (0, 1):
        entry = vocabulary.select("word", "n", size.alias("length"), _shared(side, size).alias("part"), F.lit(True).alias("entry"))
        ask = vocabulary.withColumn("length", F.explode(F.array(size - 1, size, size + 1)))
        ask = ask.select("word", "n", "length", _shared(side, F.col("length")).alias("part"), F.lit(False).alias("entry"))
        large = entry.groupBy("length", "part").count().where(F.col("count") > bucket)
        large = scratch.put(large.select("length", "part", F.ceil(F.col("count") / bucket).cast("int").alias("parts")))
        both = entry.unionByName(ask)
        if not large.isEmpty():  # no more rows than the vocabulary has buckets
            both = both.join(F.broadcast(large) if large.count() <= 1 << 16 else large, ["length", "part"], "left")
        else:
            both = both.withColumn("parts", F.lit(None).cast("int"))
        own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        piece = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("entry"), own)
        both = both.withColumn("piece", F.explode(piece.otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        sides.append(both.select(
            F.lit(side).alias("side"), F.pmod(F.xxhash64("length", "part", "piece"), F.lit(tasks)).cast("int").alias("bucket"), "entry", "word", "n"
        ))

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        entry = table.column("entry").to_numpy()
        listed = np.flatnonzero(entry)
        asked = pa.array(np.flatnonzero(~entry))
        counts = table.column("n").to_numpy()[listed].astype(np.int64)
        queries = table.column("word").take(asked).unique().to_pylist()
        rows = list(search_bucket(side, table.column("word").take(pa.array(listed)).to_pylist(), counts, queries))
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "form_n", "form"])

    found = sides[0].union(sides[1]).groupBy("side", "bucket").applyInArrow(search, "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form")
    )


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of the chain of forms from each word of ``forms`` (word, form).

    Chains double in reach each round; a form is more frequent than its word, so they end.
    """
    now = scratch.put(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.put(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")
        now.scratch_path = new.scratch_path


def spelling_variants(docs: DataFrame, *, least: int = LEAST, times: int = TIMES, bucket: int = BUCKET) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word found at least twice in ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.put(count_words(docs.select("doc_id", "text"), least).where("n >= 2"))
    near = vocabulary.join(near_words(vocabulary, scratch, bucket), "word", "left")
    good = F.col("form_n") >= times * F.col("n")
    named = scratch.put(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")
    ))
    ends = roots(named.where("form is not null"), scratch)
    out = named.join(ends, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
