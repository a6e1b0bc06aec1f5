"""Vectorised words, lines and hashes of Arrow text columns (numpy inside Spark tasks).

Texts are taken as UTF-8 bytes. Work is done in pieces of about ``PIECE`` bytes cut between
tokens, so memory follows the piece and not the text. Token hashes are 64-bit polynomial hashes of
the token's bytes, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes of white space are 0, all others 1: runs of 1 are the words ``[^\x20\x09-\x0D]+``.
WORD = np.ones(256, np.uint8)
WORD[[32, 9, 10, 11, 12, 13]] = 0
#: Runs between line feeds.
LINE = np.ones(256, np.uint8)
LINE[10] = 0
#: Letters, digits and bytes above ASCII are 1, other visible ASCII is 2.
PUNCT = WORD * 2
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Letters and digits only; everything else separates.
ALNUM = (PUNCT == 1).astype(np.uint8)

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUE = mix(np.arange(1, 257, dtype=U) * U(_BASE)) | U(1)
_tables: dict[str, np.ndarray] = {"power": np.ones(1, U), "inverse": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["power"]) < n:
        for key, base in (("power", _BASE), ("inverse", _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _tables[key] = np.cumprod(steps, dtype=U)
    return _tables["power"], _tables["inverse"]


class Tokens:
    """Tokens of a run of texts: byte ``start`` and ``end``, ``doc`` (row in the run), ``hash``."""

    __slots__ = ("start", "end", "doc", "hash")

    def __init__(self, start, end, doc, hash_):
        self.start, self.end, self.doc, self.hash = start, end, doc, hash_


class Texts:
    """A run of rows: bytes, ``offsets`` of the rows, index of the first row in its batch."""

    __slots__ = ("data", "offsets", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each row for which ``mask`` holds."""
        run = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def tokens(self, classes: np.ndarray = WORD, fold: np.ndarray = SAME) -> Tokens:
        """Runs of bytes of one class other than 0; no token crosses rows."""
        n = len(self.data)
        kind = classes[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        change = first[:n].copy()
        if n:
            change[0] = True
            change[1:] |= kind[1:] != kind[:-1]
        cuts = np.flatnonzero(change)
        ends = np.append(cuts[1:], n)
        keep = kind[cuts] != 0 if n else np.zeros(0, bool)
        start, end = cuts[keep], ends[keep]
        doc = np.repeat(np.arange(len(self)), np.diff(np.searchsorted(start, self.offsets)))
        return Tokens(start, end, doc, self._hashes(start, end, fold))

    def _hashes(self, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), U)
        value = _VALUE[fold]
        i = 0
        while i < len(start):
            low = start[i]
            j = max(i + 1, int(np.searchsorted(end, low + PIECE, "right")))
            high = end[j - 1]
            power, inverse = _powers(int(high - low) + 1)
            run = np.zeros(high - low + 1, U)
            np.cumsum(value[self.data[low:high]] * power[: high - low], out=run[1:])
            s, e = start[i:j] - low, end[i:j] - low
            out[i:j] = (run[e] - run[s]) * inverse[s]
            i = j
        return mix(out ^ ((end - start).astype(U) << U(48)))


def runs(column: pa.Array, size: int = PIECE) -> Iterator[Texts]:
    """The column's rows in runs of about ``size`` bytes (one row at least); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def grams(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` successive tokens of one row, and the index of their first token."""
    m = len(tokens.hash) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(tokens.doc[:m] == tokens.doc[n - 1 :])
    out = np.zeros(len(at), U)
    for k in range(n):
        out = mix(out * U(_BASE) + tokens.hash[at + k])
    return out, at


def sort_rows(values: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted within each row, and the bounds of the rows; ``doc`` is sorted already."""
    values = values.copy()
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    return values, bounds


def per_doc(values: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value: (values, rows)."""
    values, _ = sort_rows(values, doc, rows)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], doc[new]


def lists(values: np.ndarray, doc: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """Values sorted by row as an Arrow list column."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
