"""Token counts with a prefix table.

A byte-level BPE never merges across pre-tokens, so the count of a prefix is the count at the start of
its last pre-token plus the count of a part of one pre-token. ``PrefixTable`` stores the exact count at
every pre-token end of a text (running sums, one pass); ``count`` and ``cut`` answer any prefix and any
budget from it and from the dynamic program of one pre-token, over vocabulary entries and merge ranks: the
encoding of a string is the encoding of the string without its last token, plus that token, and each
possible last token is checked against its neighbour. The text itself is never encoded again; only a
contraction or special string is, with the pre-token before it. ``cut`` ends anywhere, also inside a
pre-token: at the largest prefix that has at most so many tokens by itself.

Pre-tokens are cut for whole runs of texts with numpy; each distinct pre-token is encoded once per task
(the store is emptied when it holds ``STORE`` entries, which costs time, not results).

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; the
special string ``<|endoftext|>`` inside a text is one token, as the library has it by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm import words as W

SPECIAL = "<|endoftext|>"
ODD = {SPECIAL, "'s", "'t", "'m", "'d", "'re", "'ve", "'ll"}
LIMIT = 512
STORE = 1 << 20

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_white = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _kinds() -> np.ndarray:
    """Class of every code point: letters, numbers, white space, others."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            if last - first == len(m[0]) - 1:
                kinds[first : last + 1] = kind
            else:
                kinds[[ord(c) for c in m[0]]] = kind
    kinds[list(_white)] = SPACE
    return kinds


class Coder:
    """Pre-tokens and their counts, for one task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kinds = _kinds()
        self.seen: dict[int, int] = {}
        self.path = path
        self.merged: dict[tuple[str, str], bool] = {}

    @cached_property
    def merges(self) -> tuple[set[str], dict[tuple[str, str], int], list[int]]:
        """Tokens as strings of one character per byte, merge ranks, and the tokens' lengths, longest first."""
        with open(self.path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        back = str.maketrans({chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(others)})
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ranks = {(a.translate(back), b.translate(back)): rank for rank, (a, b) in enumerate(pairs)}
        vocabulary = {a + b for a, b in ranks} | {chr(b) for b in range(256)}
        return vocabulary, ranks, sorted({len(t) for t in vocabulary}, reverse=True)

    def stays(self, left: str, token: str) -> bool:
        """Whether ``left`` and ``token`` side by side are encoded as these two (``token`` alone without ``left``)."""
        key = left, token
        if key not in self.merged:
            ranks, parts = self.merges[1], list(left + token)
            while len(parts) > 1:
                rank, i = min((ranks.get((parts[i], parts[i + 1]), len(ranks)), i) for i in range(len(parts) - 1))
                if rank == len(ranks):
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(self.merged) > STORE:
                self.merged.clear()
            self.merged[key] = parts == ([left, token] if left else [token])
        return self.merged[key]

    def starts(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pre-tokens of a run of texts begin; ``rows`` are the bounds of the texts."""
        n = len(points)
        kind = self.kinds[points]
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        new = edge[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        # The last white space of a run that goes on in the same text: a plain space joins what follows,
        # any other stands alone.
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n]
        at = np.flatnonzero(last)
        new[at] = True
        plain = at[points[at] == 32]
        new[plain + 1] = False
        # Contractions: an apostrophe that begins a pre-token, with s, t, m, d or re, ve, ll behind it.
        quote = np.flatnonzero(new & (points == 39))
        quote = quote[quote + 1 < n]
        if len(quote):
            same = ~edge[quote + 1]
            one = same & np.isin(points[quote + 1], [115, 116, 109, 100])
            third = np.minimum(quote + 2, n - 1)
            pair = points[quote + 1].astype(np.int64) * 65536 + points[third]
            two = same & (quote + 2 < n) & ~edge[third] & np.isin(pair, [114 * 65536 + 101, 118 * 65536 + 101, 108 * 65536 + 108])
            for hit, width in ((quote[one], 2), (quote[two], 3)):
                new[hit + 1] = False
                after = hit + width
                new[after[after < n]] = True
                # A space behind the contraction begins its own pre-token already.
        return np.flatnonzero(new)

    def counts(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        """Tokens of each pre-token."""
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys = unique.tolist()
        found = [self.seen.get(k, 0) for k in keys]
        missing = [i for i, c in enumerate(found) if not c]
        if missing:
            a, b = starts[first[missing]].tolist(), ends[first[missing]].tolist()
            coded = self.library.encode_batch_fast([text[x:y] for x, y in zip(a, b)], add_special_tokens=False)
            if len(self.seen) > STORE:
                self.seen.clear()
            for i, e in zip(missing, coded):
                found[i] = self.seen[keys[i]] = len(e)
        return np.array(found, np.int64)[back]

    def tables(self, texts: list[str]) -> list["PrefixTable"]:
        """A prefix table for each text."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for j, part in enumerate(text.split(SPECIAL)):
                if j:
                    pieces.append(SPECIAL)
                    owner.append(i)
                pieces.append(part)
                owner.append(i)
        whole = "".join(pieces)
        rows = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        special = [k for k, p in enumerate(pieces) if p is SPECIAL]
        starts = self.starts(points, rows)
        for k in special:
            starts = starts[(starts <= rows[k]) | (starts >= rows[k + 1])]
        ends = np.append(starts[1:], len(points)).astype(np.int64)
        hashes = _hashes(points, starts, ends)
        count = self.counts(hashes, starts, ends, whole)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, [len(p) for p in pieces], len(texts))))).astype(np.int64)
        cut = np.searchsorted(starts, bounds)
        return [
            PrefixTable(self, texts[i], ends[cut[i] : cut[i + 1]] - bounds[i], np.cumsum(count[cut[i] : cut[i + 1]]))
            for i in range(len(texts))
        ]

    def inner(self, pretoken: str, most: int | None = None) -> np.ndarray:
        """Token count of every prefix of one pre-token, by dynamic programming over its last token; with
        ``most``, at least up to the last prefix that has so many."""
        vocabulary, _, lengths = self.merges
        body = pretoken.encode().decode("latin-1")
        out, last, end = [0] * (len(body) + 1), [""] * (len(body) + 1), len(body)
        for j in range(1, len(body) + 1):
            for n in lengths:  # the true last token stands next to its neighbour
                token = body[j - n : j] if n <= j else ""
                if token in vocabulary and self.stays(last[j - n], token):
                    out[j], last[j] = out[j - n] + 1, token
                    break
            if most is not None and j % lengths[0] == 0 and min(out[j - lengths[0] + 1 : j + 1]) >= most:
                end = j
                break
        return np.array([c for c, b in zip(out[:end], body) if not 128 <= ord(b) < 192] + [out[end]] * (end == len(body)), np.int64)


class PrefixTable:
    """Exact token counts of the prefixes of one text."""

    def __init__(self, coder: Coder, text: str, ends: np.ndarray, totals: np.ndarray):
        self.coder, self.text, self.ends, self.totals = coder, text, ends, totals

    @property
    def total(self) -> int:
        return int(self.totals[-1]) if len(self.totals) else 0

    def _inside(self, k: int, budget: int | None = None) -> tuple[int, np.ndarray]:
        """Start of pre-token ``k`` and the counts of the prefixes that end in it, as far as ``budget`` goes.

        A prefix that ends inside a contraction or special string pre-tokenises otherwise at its end; it is
        encoded with the pre-token before. White space at the end of a prefix joins white space before it.
        """
        start, before = (int(self.ends[k - 1]), int(self.totals[k - 1])) if k else (0, 0)
        first, earlier = (int(self.ends[k - 2]), int(self.totals[k - 2])) if k > 1 else (0, 0)
        body = self.text[start : int(self.ends[k])]
        if body in ODD:
            model, whole = self.coder.library, self.text[first : int(self.ends[k])]
            return start, np.array(
                [earlier + len(model.encode(whole[: start - first + j], add_special_tokens=False)) for j in range(len(body) + 1)]
            )
        counts = before + self.coder.inner(body, None if budget is None else budget - before)
        space = lambda c: self.coder.kinds[ord(c)] == SPACE
        if k and space(body[0]) and space(self.text[start - 1]):
            joined = earlier + self.coder.inner(self.text[first : start + 1])[-1]
            counts = np.array([counts[0], joined, *counts[2:].tolist()])
        return start, counts

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        if chars <= 0:
            return 0
        k = int(np.searchsorted(self.ends, min(chars, len(self.text))))
        if k < len(self.ends) and self.ends[k] == chars and (k + 1 == len(self.ends) or self.coder.kinds[ord(self.text[chars - 1])] != SPACE):
            return int(self.totals[k])
        start, inner = self._inside(k)
        return int(inner[min(chars, len(self.text)) - start])

    def cut(self, budget: int) -> int:
        """The most code points that have at most ``budget`` tokens by themselves."""
        if self.total <= budget:
            return len(self.text)
        # Prefixes in the pre-token behind the one that exceeds the budget may still have fewer tokens.
        k = min(int(np.searchsorted(self.totals, budget, "right")) + 1, len(self.ends) - 1)
        while k >= 0 and budget > 0:
            start, counts = self._inside(k, budget)
            fits = np.flatnonzero(counts[1:] <= budget)
            if len(fits):
                return start + int(fits[-1]) + 1
            k -= 1
        return 0


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), W.U)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + W.PIECE, "right")))
        high = ends[j - 1]
        power, inverse = W._powers(int(high - low) + 1)
        run = np.zeros(high - low + 1, W.U)
        np.cumsum(W.mix(points[low:high].astype(W.U) + W.U(77)) * power[: high - low], out=run[1:])
        out[i:j] = (run[ends[i:j] - low] - run[starts[i:j] - low]) * inverse[starts[i:j] - low]
        i = j
    return W.mix(out ^ ((ends - starts).astype(W.U) << W.U(48)))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and ``cut_chars`` (code points within ``limit`` tokens). No shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for run in W.runs(batch.column(0)):
                body = run.data.tobytes()
                texts = [body[a:b].decode() for a, b in zip(run.offsets[:-1].tolist(), run.offsets[1:].tolist())]
                tables = coder.tables(texts)
                total = np.array([t.total for t in tables], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(run.first, len(run)),
                        pa.array(np.diff(run.offsets)),
                        pa.array(total),
                        pa.array(total > limit),
                        pa.array([t.cut(limit) for t in tables], pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
                )

    return docs.select("text", F.col("doc_id")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"
    )
