"""Decontamination: blocks of items change nothing, and the whole way against a plain search."""

import math
import random
import re
from collections import Counter

from citelake.llm import contamination as C


def items_and_docs(seed, n_items=60, n_docs=80):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, f"{text(rng.randrange(3, 30))}. {text(rng.randrange(2, 12))}.") for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        parts = [text(rng.randrange(0, 150))]
        for _, t in rng.sample(items, 2):
            words = t.split()
            kept = [w for w in words if rng.random() > rng.choice([0, 0, 0.1, 0.4])]
            parts += [" ".join(kept), text(rng.randrange(0, 90))]
        docs.append((d, " ".join(parts)))
    return items, docs


def tables(spark, seed):
    items, docs = items_and_docs(seed)
    return spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    items, docs = tables(spark, 3)
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.passage) for r in C.find_leaks(docs, items).collect())
    whole, kept = rows(), sorted(r.doc_id for r in C.drop_leaks(docs, items).collect())
    assert len(whole) > 60 and len(list(C.indexes(items))) == 1
    monkeypatch.setattr(C, "BLOCK_BYTES", 900)
    assert len(list(C.indexes(items))) > 4
    assert rows() == whole
    assert sorted(r.doc_id for r in C.drop_leaks(docs, items).collect()) == kept


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def plain_leaks(items, docs):
    """Every passage against every item, by the definitions of the module."""
    split = {i: words(t) for i, t in items}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(t for w in split.values() for t in set(w))
    assert max(map(len, split.values())) <= C.ENTRY  # items of one entry

    def weights(w):
        k = C.K1 * (1 - C.B + C.B * len(w) / mean)
        v = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (C.K1 + 1) / (f + k) for t, f in Counter(w).items()}
        return {t: x / sum(v.values()) for t, x in v.items()}

    def share(part, there):
        m = min(C.GRAM, len(part))
        grams = {tuple(part[i : i + m]) for i in range(len(part) - m + 1)}
        found = {tuple(there[i : i + m]) for i in range(len(there) - m + 1)}
        return len(grams & found) / len(grams)

    out, half = set(), C.PASSAGE // 2
    for i, t in items:
        weight, size = weights(split[i]), len(split[i])
        cut = len(words(t[: t.index(". ")]))
        for d, body in docs:
            w = words(body)
            for p in range(max(1, -(-len(w) // half) - 1)):
                low, high = p * half, min(p * half + C.PASSAGE, len(w))
                if sum(weight.get(x, 0) for x in set(w[low:high])) >= C.THRESHOLD - 1e-9:
                    there = w[max(low - size, 0) : high + size]
                    if min(share(split[i][:cut], there), share(split[i][cut:], there)) >= C.OVERLAP:
                        out.add((d, i))
    return out


def test_leaks_against_a_plain_search(spark):
    for seed in (5, 8):
        items, docs = tables(spark, seed)
        got = {(r.doc_id, r.item_id) for r in C.find_leaks(docs, items).collect()}
        want = plain_leaks(*items_and_docs(seed))
        assert got == want and len(want) > 40
