"""Repeated passages across documents, by prefix-partitioned suffix trees cut at the window's depth.

A suffix starts at every word. Of its first ``WINDOW`` words the least three-word hash among the first
``REACH`` places is its anchor, so its prefix, up to ``REACH`` words past the anchor, has a length that the
text itself sets. Suffixes are dealt by the words from the anchor on: equal windows have the same anchor at
the same place, so all leaves below one deep node meet, and neighbouring suffixes travel together. Partitions
are sized by the corpus, by bytes. In a partition, prefixes that occur once have no inner node and are pruned;
the other suffixes are sorted by anchor, place and the digest of the rest, and a run of equal keys is an inner
node at depth ``WINDOW``, a repeat. The smallest document of a node keeps its words, the others lose theirs.

A run of texts sends each distinct window once, for its smallest document; larger documents of the same run
are decided on the spot. A passage in a third of all documents is therefore one entry per run. Windows are
told apart by 104 bits.

Defined results: null, empty and short texts lose nothing; rows without a doc_id lose nothing and take
nothing from others; rows that repeat a doc_id never take from each other; repeated rows get the same result;
a text of any length is worked on whole; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm import words as W

WINDOW = 50  # words of a repeat
REACH = 25  # places of a window among which the anchor is chosen; fewer than WINDOW - 2
GRAM = 3  # words hashed for the choice
REST = 5  # bytes of a window's digest next to its anchor's
PART = 24 << 20  # bytes of text whose suffixes make a partition
RUN = 4 << 20  # bytes of text that are worked on together

U = W.U


def windows(tokens: W.Tokens, window: int = WINDOW, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, anchor, digest of the anchor's words and digest of the window, of every window of one row."""
    n = len(tokens.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(U), none.astype(U)
    start = np.flatnonzero(tokens.doc[: n - window + 1] == tokens.doc[window - 1 :])
    power, inverse = W._powers(n + 1)
    run = np.zeros(n + 1, U)
    np.cumsum(tokens.hash * power[:n], out=run[1:])

    def digest(at: np.ndarray, size: int) -> np.ndarray:
        return W.mix((run[at + size] - run[at]) * inverse[at])

    grams = digest(np.arange(n - GRAM + 1), GRAM)
    place = np.arange(len(grams), dtype=U)
    least = (grams & ~U((1 << 32) - 1)) | place  # ties go left; a run has fewer than 2 ** 32 words
    width = 1
    while width < reach:  # minimum over ``reach`` places by doubling
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    anchor = (least[start] & U((1 << 32) - 1)).astype(np.int64)
    return start, anchor, digest(anchor, window - reach + 1), digest(start, window)


def _pack(planes: np.ndarray) -> bytes:
    """Bytes of little-endian integers, plane by plane, so that equal high bytes compress."""
    return planes.reshape(-1, 1).view(np.uint8).reshape(len(planes), planes.dtype.itemsize).T.tobytes()


def _unpack(data: memoryview, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.copy().view(kind).ravel()


_SUFFIX = (np.uint64, np.int64, np.int64, np.uint32, np.uint32)  # digest of the prefix, doc_id, text, anchor, places
_SPAN = (np.int64, np.int64, np.uint32, np.uint32)  # doc_id, text, anchor, places
SPANS = "doc_id long, key long, anchor long, places long"


def _first_rows(ids: np.ndarray, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Whether a row has an id and does not repeat an earlier one."""
    order = np.lexsort((np.arange(len(ids)), keys, ids))
    new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1]))
    out = np.zeros(len(ids), bool)
    out[order[new]] = True
    return out & ~null


def cut_suffixes(texts: W.Texts, ids: np.ndarray, keys: np.ndarray, null: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, suffixes, spans, bytes): the suffixes of a run for each partition, and windows that are already
    known to lie in a smaller document of the run. Places are bits: how far before its anchor a window starts."""
    tokens = texts.tokens()
    start, anchor, prefix, whole = windows(tokens)
    some = _first_rows(ids, keys, null)[tokens.doc[start]]
    start, anchor, prefix, whole = (x[some] for x in (start, anchor, prefix, whole))
    if not len(start):
        return
    doc = tokens.doc[start]
    order = np.argsort(whole, kind="stable")
    first = np.flatnonzero(np.append(True, whole[order][1:] != whole[order][:-1]))
    smallest = np.empty(len(start), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(ids[doc[order]], first), np.diff(np.append(first, len(order))))
    later = ids[doc] > smallest
    place = np.uint32(1) << (anchor - start).astype(np.uint32)

    group = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    decided = np.bitwise_or.reduceat(np.where(later, place, np.uint32(0)), group)
    sent = np.bitwise_or.reduceat(np.where(later, np.uint32(0), place), group)
    row_start = np.searchsorted(tokens.doc, np.arange(len(texts)))
    head, own, text = prefix[group], ids[doc[group]], keys[doc[group]]
    at = anchor[group] - row_start[doc[group]]
    part = ((head >> U(33)) * U(parts) >> U(31)).astype(np.int64)
    rest = np.ascontiguousarray(W.mix(whole ^ prefix)).view(np.uint8).reshape(-1, 8)[:, :REST]
    rest = rest[~later]  # in the order of the anchors, then of the starts
    size = np.bitwise_count(sent).astype(np.int64)
    offset = np.cumsum(size) - size
    by_part = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        mine = by_part[bounds[p] : bounds[p + 1]]
        found, mine = mine[decided[mine] > 0], mine[sent[mine] > 0]
        data = [_pack(c[mine].astype(k)) for c, k in zip((head, own, text, at, sent), _SUFFIX)]
        data.append(rest[_ranges(offset[mine], size[mine])].tobytes())
        data += [_pack(c[found].astype(k)) for c, k in zip((own, text, at, decided), _SPAN)]
        yield p, len(mine), len(found), b"".join(data)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def suffixes(docs: DataFrame, parts: int) -> DataFrame:
    """(part, n, m, packed): one row for a run of texts and a partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.asarray(batch.column(1).is_null())
            ids = np.asarray(batch.column(1).fill_null(0)).astype(np.int64)
            keys = np.asarray(batch.column(2)).astype(np.int64)
            for texts in W.runs(batch.column(0), RUN):
                rows = slice(texts.first, texts.first + len(texts))
                for p, n, m, data in cut_suffixes(texts, ids[rows], keys[rows], null[rows], parts):
                    columns = [pa.array([p], pa.int32()), pa.array([n], pa.int32()), pa.array([m], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "n", "m", "packed"])

    return docs.select("text", "doc_id", "key").mapInArrow(cut, "part int, n int, m int, packed binary")


def deep_nodes(table: pa.Table) -> pa.Table:
    """Windows of a partition that a smaller document has too, as (doc_id, key, anchor, places)."""
    fields, spans, rests = [[] for _ in _SUFFIX], [[] for _ in _SPAN], []
    for n, m, data in zip(table.column("n").to_pylist(), table.column("m").to_pylist(), table.column("packed")):
        view, low = memoryview(data.as_buffer()), 0
        for column, kind in zip(fields, _SUFFIX):
            column.append(_unpack(view[low:], n, kind))
            low += n * np.dtype(kind).itemsize
        high = len(view) - m * sum(np.dtype(k).itemsize for k in _SPAN)
        rests.append(np.frombuffer(view[low:high], np.uint8))
        for column, kind in zip(spans, _SPAN):
            column.append(_unpack(view[high:], m, kind))
            high += m * np.dtype(kind).itemsize
    known = [np.concatenate(c).astype(np.int64) for c in spans]
    head, doc, key, at, sent = (np.concatenate(c) for c in fields)
    rest = np.concatenate(rests).reshape(-1, REST)

    order = np.argsort(head, kind="stable")
    new = np.append(True, head[order][1:] != head[order][:-1])[: len(order)]
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    branching = np.repeat(times > 1, times)  # a prefix that occurs once has no inner node
    inner, node = order[branching], (np.cumsum(new) - 1)[branching]
    if len(inner):
        size = np.bitwise_count(sent).astype(np.int64)
        offset = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(inner)), size[inner])
        digest = np.zeros((len(owner), 8), np.uint8)
        digest[:, :REST] = rest[_ranges(offset[inner], size[inner])]
        bits = ((sent[inner][:, None] >> np.arange(31, -1, -1, dtype=np.uint32)) & 1).astype(bool)
        place = (31 - np.nonzero(bits)[1]).astype(U)  # the window that starts first is farthest from the anchor
        label = digest.view(np.uint64).ravel() | place << U(8 * REST)
        leaf = np.lexsort((label, node[owner]))
        first = np.flatnonzero(np.append(True, (label[leaf][1:] != label[leaf][:-1]) | (node[owner[leaf]][1:] != node[owner[leaf]][:-1])))
        least = np.minimum.reduceat(doc[inner[owner[leaf]]], first)
        smallest = np.empty(len(leaf), np.int64)
        smallest[leaf] = np.repeat(least, np.diff(np.append(first, len(leaf))))
        lost = doc[inner[owner]] > smallest
        each = np.cumsum(size[inner]) - size[inner]
        marks = np.bitwise_or.reduceat(np.where(lost, U(1) << place, U(0)), each)
        some = np.flatnonzero(marks)
        rows = inner[some]
        known = [np.concatenate((k, c.astype(np.int64))) for k, c in zip(known, (doc[rows], key[rows], at[rows], marks[some]))]
    return pa.table([pa.array(c) for c in known], ["doc_id", "key", "anchor", "places"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, key and ``marks``, the windows of each row of ``docs`` (doc_id, text, key) that a smaller document
    has too, as pairs of an anchor and the places before it; at most as many pairs as the text has words."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cut = suffixes(docs, max(1, -(-total // PART)))
    found = cut.groupBy("part").applyInArrow(deep_nodes, SPANS)
    return found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "places")).alias("marks"))


def _covered(tokens: W.Tokens, rows: int, marks: pa.Array) -> np.ndarray:
    """Words of each row inside one of its marked windows."""
    step = np.zeros(len(tokens.hash) + 1, np.int64)
    offsets = np.asarray(marks.offsets).astype(np.int64)
    pairs = marks.values
    anchor, places = (np.asarray(pairs.field(k))[offsets[0] : offsets[-1]].astype(np.int64) for k in ("anchor", "places"))
    row = np.repeat(np.arange(rows), np.diff(offsets))
    which, place = np.nonzero(places[:, None] >> np.arange(REACH) & 1)
    start = np.searchsorted(tokens.doc, np.arange(rows))[row[which]] + anchor[which] - place
    np.add.at(step, start, 1)
    np.add.at(step, start + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def _joined(texts: W.Texts, tokens: W.Tokens, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all rows, one space between two of a row, and where each row begins."""
    edge = np.zeros(len(texts.data) + 1, np.int8)
    edge[tokens.start[kept]] = 1
    ends = np.zeros(len(texts.data) + 1, np.int8)
    ends[tokens.end[kept]] = 1
    keep = np.cumsum(edge - ends, dtype=np.int8)[:-1].astype(bool)
    word = np.flatnonzero(kept)
    between = tokens.end[word[:-1][tokens.doc[word[:-1]] == tokens.doc[word[1:]]]]
    keep[between] = True
    data = texts.data.copy()
    data[between] = 32
    run = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], run[texts.offsets]


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, the words that are left joined by one space, of each row."""
    return _without_repeats(docs, False)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    return _without_repeats(docs, True)


def _without_repeats(docs: DataFrame, digest: bool) -> DataFrame:
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    marked = repeated_windows(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).hint("shuffle_hash")
    name = "kept_sha256" if digest else "kept_text"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            for texts in W.runs(batch.column(0), RUN):
                rows = len(texts)
                tokens = texts.tokens()
                gone = _covered(tokens, rows, marks.slice(texts.first, rows))
                data, cuts = _joined(texts, tokens, ~gone)
                left = [data[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                columns = [
                    batch.column(1).slice(texts.first, rows),
                    pa.array(np.bincount(tokens.doc, minlength=rows)),
                    pa.array(np.bincount(tokens.doc[gone], minlength=rows)),
                    pa.array([hashlib.sha256(x).hexdigest() if digest else x.decode() for x in left], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", name])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = F.coalesce("marks", F.array().cast("array<struct<anchor:bigint,places:bigint>>"))
    rows = docs.join(marked, ["doc_id", "key"], "left").select("text", "doc_id", marks.alias("marks"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, {name} string")
