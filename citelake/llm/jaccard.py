"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Texts of one shingle set form a class; only classes are joined. All shingles have one global order:
shingles found often in a bounded sample last, the others by hash. The sample steers the order only,
never the result. For similarity ``t`` the first ``n - ceil(t n) + l`` shingles of two linked sets
share at least ``l``; each class lengthens its prefix (``l`` up to ``LONGEST``) as the measured
frequency of the added shingles makes lookups plus expected verifications cheapest, and a pair is
verified only if its prefixes share the smaller ``l`` of the two. Before prefixes are compared, a pair must
pass a bound from about one bit a shingle: bits that flip with every shingle of a cell, so that the bits in which
two classes differ are at most the shingles in which they do.

Groups of near copies are not paired out. First every prefix shingle compares its members with one
member alone (the one with the fewest rarer shingles); verified links give components. Then only
members of different components are paired, after size and position bounds, so that no link between
components is lost. All comparisons end in an exact check on whole sets.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own
component; fewer words than the width make one shingle of the whole sequence; rows with a null id
have component null unless a row with an id has the same set, and pass no link on; repeated rows are linked;
rows that repeat an id with another text follow their text. Sets are told apart by a 64-bit digest,
shingles by 64-bit hashes. Other columns are ignored; ``drop_near_copies`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm import words as W
from citelake.llm.components import components
from citelake.llm.store import Scratch, modest

SAMPLE = 8_192  # documents, about, whose shingles are counted for the order
OFTEN = 3  # counts in the sample from which a shingle is ordered by frequency
FREQUENT = 1 << 16  # such shingles at most; those beyond are ordered by hash
LONGEST = 4  # largest multi-match requirement l
VERIFY = 8.0  # cost of verifying one candidate in lookups
PARITY = 8  # 64-bit words of parity bits of a small class


@dataclass(frozen=True)
class Join:
    width: int = 3
    percent: int = 90
    fold: bool = True

    def least(self, n: Column) -> Column:
        """Smallest intersection of a set of ``n`` with a linked set: ceil(n * percent / 100)."""
        return F.floor((n * self.percent + 99) / 100).cast("int")

    def both(self, n: Column, m: Column) -> Column:
        """Smallest intersection of linked sets of ``n`` and ``m``."""
        return F.ceil((n + m) * self.percent / F.lit(100.0 + self.percent) - 1e-9).cast("int")


#: Five words and a similarity of 0.8: near copies of the pipeline.
NEAR = Join(width=5, percent=80)


def _sets(texts: W.Texts, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by row and hash."""
    tokens = texts.tokens(W.WORD, W.LOWER if join.fold else W.SAME)
    hashes, at = W.grams(tokens, join.width)
    doc = tokens.doc[at]
    count = np.bincount(tokens.doc, minlength=len(texts))
    for k in range(1, join.width):
        short, first = W.grams(tokens, k)
        whole = count[tokens.doc[first]] == k
        hashes, doc = np.concatenate((hashes, short[whole])), np.concatenate((doc, tokens.doc[first[whole]]))
    if join.width > 1:
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    return W.per_doc(hashes, doc, len(texts))


def _digest(values: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, W.U)
    if len(values):
        mixed = W.mix(values * W.U(0xD6E8FEB86659FD93) + W.U(0x5851F42D4C957F2D))
        run = np.concatenate((np.zeros(1, W.U), np.cumsum(mixed, dtype=W.U)))
        bounds = np.searchsorted(doc, np.arange(rows + 1))
        out = W.mix((run[bounds[1:]] - run[bounds[:-1]]) ^ (np.diff(bounds).astype(W.U) << W.U(40)))
    return out.view(np.int64)


def _parity(values: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per row, bits that tell whether the shingles of a cell are odd in number; as many cells as shingles, in
    steps of four times."""
    words = np.full(len(n), PARITY)
    while (few := n > 64 * words).any():
        words[few] *= 4
    offsets = np.concatenate(([0], np.cumsum(words)))
    cell = (W.mix(values ^ W.U(0xA24BAED4963EE407)) % (64 * words[doc]).astype(W.U)).astype(np.int64)
    odd = (np.bincount(64 * offsets[doc] + cell, minlength=64 * int(offsets[-1])) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def frequent_shingles(docs: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of about ``SAMPLE`` documents and their counts, sorted by hash."""
    total = docs.count()
    part = min(1.0, SAMPLE / max(total, 1))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_sets(texts, join)[0].view(np.int64))], ["s"])

    counts = picked.select("text").mapInArrow(shingles, "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()
    rows = rows.assign(u=rows["s"].to_numpy(np.int64).view(W.U)).sort_values("u")
    return rows["u"].to_numpy(W.U), rows["count"].to_numpy(np.int64)


def signatures(docs: DataFrame, join: Join, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, set size ``n``, class ``k``, its parity bits and the longest ``prefix`` in global order."""
    often, counts = order

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.runs(batch.column(0)):
                rows = len(texts)
                values, doc = _sets(texts, join)
                n = np.bincount(doc, minlength=rows)
                k = _digest(values, doc, rows)
                parity = _parity(values, doc, n)
                rank = np.zeros(len(values), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                    rank = np.where(often[at] == values, counts[at], 0)
                later = np.flatnonzero(rank)  # few; the rest keeps its order by hash
                moved = np.lexsort((values[later], rank[later], doc[later]))
                early = np.flatnonzero(rank == 0)
                order_ = np.concatenate((early, later[moved]))
                order_ = order_[np.argsort(doc[order_], kind="stable")]
                values = values[order_]
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                keep = place < np.repeat(n - (n * join.percent + 99) // 100 + LONGEST, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(texts.first, rows),
                        pa.array(n.astype(np.int32)),
                        pa.array(k),
                        parity,
                        W.lists(values[keep].view(np.int64), doc[keep], rows, pa.int64()),
                    ],
                    ["doc_id", "n", "k", "parity", "prefix"],
                )

    return docs.select("text", "doc_id").mapInArrow(sign, "doc_id long, n int, k long, parity array<long>, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(k, tokens): the sets of the classes ``wanted`` (doc_id, k), made anew from their texts; repeated rows
    of a class give its set repeatedly."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = np.asarray(batch.column(1))
            for texts in W.runs(batch.column(0)):
                rows = len(texts)
                values, doc = _sets(texts, join)
                k = _digest(values, doc, rows)
                same = np.flatnonzero(k == expected[texts.first : texts.first + rows])
                tokens = W.lists(values.view(np.int64), doc, rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k[same]), tokens.take(pa.array(same))], ["k", "tokens"])

    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "k")
    return rows.mapInArrow(build, "k long, tokens array<long>")


def choose_lengths(postings: DataFrame, join: Join) -> DataFrame:
    """(k, l): the multi-match requirement of each class by estimated candidate cost.

    With ``S(l)`` postings met by the prefix for ``l``, at most ``S(l) / l`` classes share ``l`` of its
    shingles; the cost is ``S(l) + VERIFY * S(l) / l``.
    """
    base = F.col("n") - join.least(F.col("n"))
    met = [F.sum(F.when(F.col("i") < base + l, F.col("g") - 1).otherwise(0)) for l in range(1, LONGEST + 1)]
    costs = [
        F.struct((s * (1 + VERIFY / l)).alias("cost"), F.lit(l).alias("l")) for l, s in enumerate(met, 1)
    ]
    best = F.least(*costs)["l"]
    return postings.groupBy("k", "n").agg(best.alias("l")).select("k", F.least("l", F.greatest(join.least(F.col("n")), F.lit(1))).alias("l"))


def _near(a: str, b: str, join: Join) -> Column:
    """Size bound, and the overlap that is left if this shingle is the first that both share.

    A linked pair passes at its first shared shingle, so rows are judged one by one; where the shared
    shingle before this one is the same in both, this is not the first.
    """
    n, m, i, j = (F.col(f"{x}.{c}") for c in ("n", "i") for x in (a, b))
    left = 1 + F.least(n - i - 1, m - j - 1)
    first = F.coalesce(F.col(f"{a}.before") != F.col(f"{b}.before"), F.lit(True))
    return (join.least(F.greatest(n, m)) <= F.least(n, m)) & (left >= join.both(n, m)) & first


def plausible(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) whose parity bits differ in no more places than linked sets may differ in shingles;
    classes with different numbers of cells all pass."""
    left, right = (classes.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in "ab")
    flips = F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.when(F.size("p_a") == F.size("p_b"), F.aggregate(flips, F.lit(0), lambda s, x: s + x)).otherwise(0)
    n, m = F.col("n_a"), F.col("n_b")
    return pairs.join(left, "a").join(right, "b").where(differ <= n + m - 2 * join.both(n, m)).select("a", "b")


def multi_match(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose own prefixes share at least the smaller requirement."""
    left = prefixes.select(F.col("k").alias("a"), F.col("own").alias("own_a"), F.col("l").alias("l_a"))
    right = prefixes.select(F.col("k").alias("b"), F.col("own").alias("own_b"), F.col("l").alias("l_b"))
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return pairs.join(left, "a").join(right, "b").where(shared >= F.least("l_a", "l_b")).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, pivots: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) that are linked, by whole sets; ``pivots`` are the distinct ``b``."""
    left = sets.withColumnRenamed("k", "a").join(pairs, "a").select("a", "b", F.col("tokens").alias("x"))
    right = sets.withColumnRenamed("k", "b").join(pivots, "b").select("b", F.col("tokens").alias("y"))
    both = left.join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("c"))
    return both.where(F.col("c") * 100 >= join.percent * (F.col("n") + F.col("m") - F.col("c"))).select("a", "b")


def candidates(met: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b) of a join of postings."""
    return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_copies(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = scratch.put(
        signatures(docs, join, frequent_shingles(docs, join)).withColumn("r", F.monotonically_increasing_id())
    )
    classes = scratch.put(
        signed.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("rep"), F.min("r").alias("first"))
    )
    other = scratch.put(
        signed.where("n > 0").select("k", "r").join(classes, "k").where("r <> first or rep is null").select("r")
    )
    reps = signed.where("n > 0").join(modest(other), "r", "left_anti")

    rows = reps.select("k", "n", F.posexplode("prefix").alias("i", "s"))
    shared = scratch.put(rows.groupBy("s").agg(F.count("*").alias("g")).where("g > 1"))
    postings = scratch.put(rows.join(shared, "s"))
    chosen = scratch.put(choose_lengths(postings, join))
    reach = F.col("n") - join.least(F.col("n")) + F.col("l")
    prefixes = scratch.put(reps.join(modest(chosen), "k").select("k", "l", F.slice("prefix", 1, reach).alias("own")))
    postings = scratch.put(postings.join(modest(chosen), "k").where(F.col("i") < reach).select(
        "s", "k", "n", "i", F.lag("s").over(Window.partitionBy("k").orderBy("i")).alias("before")  # bounded by a prefix
    ))

    sketches = reps.select("k", "n", "parity")
    again = scratch.put(signed.where("n > 0").groupBy("doc_id", "k").count().where("count > 1").select("k").distinct())
    repeated = not again.isEmpty()

    def linked(pairs: DataFrame) -> DataFrame:
        """Links (a, b) among candidates: parity bits, shared prefixes, then whole sets made from the texts."""
        pairs = scratch.put(plausible(pairs, sketches, join))
        met = scratch.put(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct())
        close = scratch.put(multi_match(pairs, prefixes.join(modest(met), "k", "left_semi")))
        met = close.select(F.col("a").alias("k")).union(close.select(F.col("b").alias("k"))).distinct()
        wanted = scratch.put(met.join(classes, "k").select(F.col("rep").alias("doc_id"), "k"))
        sets = whole_sets(docs, modest(wanted), join)
        if repeated:  # the set of a class once
            once = sets.join(modest(again), "k", "left_semi").dropDuplicates(["k"])
            sets = sets.join(modest(again), "k", "left_anti").union(once)
        sets = scratch.put(sets)
        ends = scratch.put(close.select("b").distinct())
        links = scratch.put(verify(modest(close), sets, modest(ends), join))
        scratch.drop(sets, ends, wanted, close, pairs)
        return links

    pivots = scratch.put(postings.groupBy("s").agg(F.min(F.struct("i", "k", "n", "before")).alias("p")).select("s", "p.*"))
    stars = postings.alias("x").join(
        pivots.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.k") != F.col("y.k")) & _near("x", "y", join)
    )
    links = linked(candidates(stars, "x.k", "y.k"))
    parts = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

    part = parts.select(F.col("u").alias("k"), F.col("v").alias("of"))
    labelled = postings.join(part, "k", "left").withColumn("c", F.coalesce("of", "k"))
    labelled = labelled.join(pivots.select("s", F.col("k").alias("pivot")), "s").where("k <> pivot")  # met already
    open_ = labelled.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    labelled = scratch.put(labelled.join(open_, "s").select("s", "k", "n", "i", "before", "c"))
    apart = (F.col("x.k") < F.col("y.k")) & (F.col("x.c") != F.col("y.c"))
    rest = labelled.alias("x").join(
        labelled.alias("y"), (F.col("x.s") == F.col("y.s")) & apart & _near("x", "y", join)
    )
    rest = scratch.put(candidates(rest, "x.k", "y.k"))
    if not rest.isEmpty():
        more = linked(rest).select(F.col("a").alias("u"), F.col("b").alias("v"))
        parts = components(more.union(parts), scratch)
        part = parts.select(F.col("u").alias("k"), F.col("v").alias("of"))
    scratch.drop(postings, pivots, links, labelled, rest, prefixes, chosen, shared)

    of_class = classes.join(part, "k", "left").withColumn("c", F.coalesce("of", "k"))
    least = of_class.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = of_class.join(least, "c").select("k", "component_id")
    out = signed.select("doc_id", "n", "k").join(named, "k", "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    A repeated row of that id stays once. Documents without words or without an id all stay.
    """
    found = near_copies(docs, join)
    kept = docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    twice = found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
