"""Ranked search, repeated passages and spelling variants against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from citelake.llm import lexical, repeats, spelling
from citelake.llm import words as W
from citelake.llm.oracle import ORACLE
from citelake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# Ranked search


def brute_ranking(docs, items, k):
    said = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n, total = len(said), sum(sum(c.values()) for _, c in said)
    held = Counter(t for _, c in said for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t or "")))
    out = []
    for item, terms in asked.items():
        rows = []
        for doc, c in said:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)]
    return out


def ranked(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as term", "3 as block")
    return sorted(map(tuple, lexical.rank_documents(d, i, **how).collect()), key=repr)


@pytest.mark.parametrize("block", [lexical.BLOCK, 40])
def test_ranking_against_brute_force(spark, block):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x_y", "日本"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(80)]
    docs += [(None, text(30)), (5, docs[5][1]), (5, docs[5][1]), (200, None), (201, ""), (202, "!! ..\n"), (203, docs[7][1]), (1, "W0 w0 W0"), (300, text(9000))]
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(3, "w50 w51"), (40, None), (41, ""), (42, "nowhere"), (43, text(200)), (None, "w1 w2")]
    got = ranked(spark, docs, items, k=20, block=block)
    assert got == sorted(brute_ranking(docs, items, 20), key=repr)


def test_ranking_of_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a b")], []) == [] and ranked(spark, [(1, None)], [(1, None)]) == []


def test_graph_sums_and_shares():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 62, 8).astype(np.uint64)
    items = [np.unique(np.concatenate((common[: rng.integers(3, 9)], rng.integers(0, 1 << 62, rng.integers(0, 90)).astype(np.uint64)))) for _ in range(30)]
    graph = lexical.Graph(items)
    parts = rng.integers(0, 1000, (len(graph.terms), 7))
    want = np.array([parts[np.searchsorted(graph.terms, t)].sum(0) for t in items])
    assert (graph.scores(parts) == want).all()
    assert graph.nodes - len(graph.terms) + len(graph.tops) < sum(map(len, items))  # fewer additions than terms


# Repeated passages


def brute_repeats(docs, window):
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def repeat_rows(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    passages = [text(rng.randrange(45, 140)) for _ in range(4)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [text(rng.randrange(0, 70)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        if rng.random() < 0.3:
            parts.append(rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", " \t\n"]).join(parts)))
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    near = rows[5][1].split(" ")
    near[len(near) // 2] = "changed"
    spam = "again and again " * 200
    rows += [(3000, " ".join(near)), (3001, None), (3002, ""), (3003, " \n "), (3004, "é " * 49), (3005, "é " * 50), (3006, "é " * 51), (3007, "ü" * 3),
             (3008, spam), (3009, spam), (3010, spam + passages[0]), (rows[3][0], rows[3][1]), (rows[4][0], passages[1]), (None, rows[3][1]),
             (-7, passages[2]), (9000, text(60_000)), (9001, " ".join(WORD.findall(rows[0][1])) + "  ")]
    rng.shuffle(rows)
    return rows


def test_repeats_against_brute_force(spark, monkeypatch):
    rows = repeat_rows(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as key", "1 as marks", "2 as part", "3 as anchor")
    want = brute_repeats(rows, repeats.WINDOW)
    assert sum(r[2] > 0 for r in want) > 60
    for part, pieces in ((repeats.PART, 1), (1 << 16, 7)):
        monkeypatch.setattr(repeats, "PART", part)
        got = repeats.repeat_digests(docs.repartition(pieces))
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    texts = {hashlib.sha256(r.kept_text.encode()).hexdigest() for r in repeats.drop_repeats(docs).collect()}
    assert texts == {r[3] for r in want}


def test_repeats_of_an_empty_table(none):
    assert repeats.repeat_digests(none).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    a = [f"t{rng.randrange(9)}" for _ in range(80)]
    texts = [" ".join(a), " ".join(["x"] * 13 + a[10:] + ["y"] * 40)]
    import pyarrow as pa

    run = next(W.runs(pa.array(texts)))
    tokens = run.tokens()
    start, anchor, prefix, whole = repeats.windows(tokens)
    assert ((anchor >= start) & (anchor < start + repeats.REACH)).all()
    seen = defaultdict(set)
    for s, c, p, w in zip(start.tolist(), anchor.tolist(), prefix.tolist(), whole.tolist()):
        seen[w].add((c - s, p))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) < len(start)


# Spelling variants


def brute_variants(docs):
    counts = Counter()
    for i, t in docs:
        for run in LETTERS.findall(t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_hole = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_hole[w[:k], w[k + 1 :]].add(w)
    near = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            near[w] |= by_hole[w[:k], w[k + 1 :]] - {w}
            short = w[:k] + w[k + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out, key=repr)


def variant_rows(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeiourstéñ") for _ in range(rng.randrange(6, 14))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab" * 20, "Großmutter", "straße×÷straße"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = rng.choices(stems, [1 / (k + 1) for k in range(len(stems))])[0]
            if rng.random() < 0.12:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "É" + w[k + 1 :]])
            words.append(rng.choice([w, w.capitalize(), w.upper()]))
        rows.append((i, rng.choice([" ", "-", "1", "日", "¿"]).join(words)))
    rows += [(600, "chainlink " * 900 + "chainlinks " * 60 + "chainlinkso " * 3)]
    rows += [(500, None), (501, ""), (None, "variant " * 50 + "variante"), (3, rows[3][1]), (502, "Ünterwegs " * 30_000), (503, "q" * 5000 + " " + "q" * 5000), (504, "q" * 5001 + " " + "q" * 5001)]
    return rows


@pytest.mark.parametrize("bucket", [spelling.BUCKET, 30])
def test_variants_against_brute_force(spark, bucket):
    rows = variant_rows(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as word", "1 as n", "2 as form", "3 as side")
    got = spelling.spelling_variants(docs, bucket=bucket).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute_variants(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert any(r[3] for r in want) and any(r[3] and r[5] != r[3] for r in want)


def test_variants_of_an_empty_table(none):
    assert spelling.spelling_variants(none).count() == 0


def test_crc_of_runs():
    data = np.frombuffer("12:été".encode(), np.uint8)
    first = np.array([zlib.crc32(b"12:")], np.uint32)
    assert spelling.run_hashes(data, np.array([3]), np.array([len(data)]), first)[0] == zlib.crc32(data.tobytes())


# Twins


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_their_twins(spark, small, name):
    if small is None:
        pytest.skip("no tables")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    got = QUERIES[name](spark, small)
    want = con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.select(*columns).fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr) and rows
