"""Operators against brute force, and on nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from citelake.llm import chat, contamination, jaccard, lm, mixing, quality, secrets, sharding, tokens, toxicity
from citelake.llm import words as W
from citelake.llm.components import components
from citelake.llm.queries import QUERIES, vocabulary
from citelake.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_quality_base(docs, labels):
    got = sorted(tuple(r) for r in quality.quality_rules(docs, labels).select(
        F_or_min("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, t in texts(docs):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want.append((-1 if i is None else i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                     len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want)


def F_or_min(name):
    from pyspark.sql import functions as F

    return F.coalesce(F.col(name), F.lit(-1))


def test_quality_keeps_columns_and_clean_rows(docs, labels, none):
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 3, *range(20, 80)} <= ids and not ids & {4, 5, 6, 7, 10, 11}
    assert quality.filter_quality(none, labels).count() == 0
    assert {r.llr for r in quality.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def brute_components(rows, width, percent, fold=lower):
    sets = {}
    for i, t in rows:
        w = WORD.findall(fold(t))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    of = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if of[b] < of[a] and x and 100 * len(x & y) >= percent * len(x | y):
                    of[a] = of[b]
    return of, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("join", [jaccard.Join(), jaccard.NEAR, jaccard.Join(width=2, percent=60)])
def test_jaccard_against_brute_force(spark, join):
    rng = random.Random(5)
    rows, base = [], [f"w{i}" for i in range(60)]
    for i in range(90):
        w = list(base) if i % 3 else [f"v{rng.randrange(40)}" for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 6)):
            if w:
                w[rng.randrange(len(w))] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), join).collect()
    of, n = brute_components(rows, join.width, join.percent)
    assert {r.doc_id: r.component_id for r in got} == of
    assert {r.doc_id: r.n_shingles for r in got} == n


def test_jaccard_odd_rows(docs, none):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(docs).collect()}
    assert rows[3][1] == 1 and rows[2][1] == 1 and rows[8] == (1, 7) and rows[4] == (0, 4) and rows[5] == (0, 5) and rows[None][1] is None
    kept = jaccard.drop_near_copies(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert not {2, 3, 8} & set(ids) and {1, 4, 5, 6, None} <= set(ids)
    assert jaccard.near_copies(none).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (101, 100)]
    out = components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark))
    assert {r.u: r.v for r in out.collect()} == {**{i: 0 for i in range(1, 31)}, 101: 100}


def test_subset_counts_reach_the_budget():
    rng = random.Random(1)
    for _ in range(60):
        sizes = np.array(sorted(rng.sample(range(1, 60), rng.randrange(1, 8))))
        counts = np.array([rng.randrange(1, 5) for _ in sizes])
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        budget = rng.randrange(0, int(sizes @ counts) + 5)
        take = mixing.subset_counts(sizes, counts, budget)
        assert (0 <= take).all() and (take <= counts).all()
        assert int(sizes @ take) == max(x for x in sums if x <= budget)


def test_mix(docs, none):
    rows = mixing.mix_sizes(docs).collect()
    assert len(rows) == docs.count() and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(x for x in size if x is not None) + [None]
    left, open_, goal = 1.5 * sum(size.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        for s in over or list(open_):
            goal[s] = min(share[s], 2 * size[s])
            left -= goal[s]
            del open_[s]
    assert {round(r.target, 6) for r in rows} == {round(x, 6) for x in goal.values()}
    again = mixing.mix_sizes(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_sizes(none).count() == 0 and mixing.mix(none).count() == 0


def test_toxicity(spark, none, labels):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        w = [f"w{rng.randrange(400)}" for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(60)] = "vile" + rng.choice("abc")
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            marks.append((i, int(bad)))
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(d, m).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in out.items())
    held = [i for i in out if out[i].held_out]
    right = sum(out[i].predicted == int(i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert {r.score for r in toxicity.score_toxicity(d, m.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_toxicity_odd_rows(docs, labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_chat_round_trip():
    rng = random.Random(3)
    bits = [*chat.CONTROL, "\\", "<", "[", "/", "s>", "INST]", " ", "é", "\n", "<\\s>", "</\\s>"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool[BODY]", "a\\"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for _ in range(rng.randrange(5))]
        whole = "".join("".join(s for s, _, _ in chat.layout(r, t)) for r, t in turns)
        assert chat.parse(whole) == turns
        assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def test_chat_digest(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (1, 2, None, None), (2, 0, "assistant", None), (None, 0, "system", "<|endoftext|>"), (1, 1, "assistant", said)]
    path = vocabulary("byte_bpe_50k.json")
    c = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids long")
    out = {r.conv_id: r for r in chat.digest(chat.assemble(chat.encode_turns(c, path)), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 4 and out[1].turns_sha256 == sha(f"user\n{said}\n" + f"assistant\n{said}\n" * 2 + "\n\n")
    assert (out[1].loss_chars, out[1].loss_sha256) == (2 * len(said), sha(said * 2))
    assert out[2].loss_chars == 0 and out[None].turns_sha256 == sha("system\n<|endoftext|>\n")
    assert chat.digest(chat.assemble(chat.encode_turns(c.limit(0), path)), path).count() == 0


def test_token_prefixes():
    coder = tokens.Coder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(4)
    bits = ["'", "'s", "'re", " ", "  ", "\n", "\t", "a", "bc", "é", "12", "!", "<|endoftext|>", "<|", "日本", " ", " ", "😀", "it's", "''s", "\x85"]
    samples = ["".join(rng.choices(bits, k=rng.randrange(20))) for _ in range(200)] + ["", "<|endoftext|>"]
    for t in coder.tables(samples):
        assert [t.count(i) for i in range(len(t.text) + 1)] == [len(coder.library.encode(t.text[:i], add_special_tokens=False)) for i in range(len(t.text) + 1)]
        assert t.total == t.count(len(t.text))
        for budget in (0, 1, 3, 8):
            assert len(coder.library.encode(t.text[: t.cut(budget)], add_special_tokens=False)) <= budget or budget >= t.total


def test_token_cut_ends_inside_pretokens():
    coder = tokens.Coder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(9)
    size = lambda t: len(coder.library.encode(t, add_special_tokens=False))
    letters = "".join(rng.choices("etaoinshrdlu", k=400))
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300))
    bits = ["'s", "'re", " ", "  ", "\n", "word", "international", "é", "2024", "!!", "<|endoftext|>", "日本語", "😀"]
    samples = [letters, han, "a" * 700, " " * 300 + "b", "'" * 300, "x" + " \n" * 50 + " y", *("".join(rng.choices(bits, k=12)) for _ in range(60))]
    for t in coder.tables(samples):
        sizes = [size(t.text[:i]) for i in range(len(t.text) + 1)]
        assert [t.count(i) for i in range(len(t.text) + 1)] == sizes
        for budget in (0, 1, 2, 3, 5, 7, 12, 40, 100):
            assert t.cut(budget) == max(i for i, n in enumerate(sizes) if n <= budget), (t.text, budget)
    long = han * 40
    cut = coder.tables([long])[0].cut(512)
    assert size(long[:cut]) <= 512 < size(long[: cut + 1])


def test_token_counts(docs, none):
    path = vocabulary("byte_bpe_50k.json")
    library = tokens.Coder(path).library
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path).collect())
    want = [(i or -1, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 512) for i, t in texts(docs)]
    assert got == sorted(want) and tokens.count_tokens(none, path).count() == 0


def test_secrets(spark, docs, none):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    lines = [f"text password={hexes(18)} more thstonanderingly words token = \"{hexes(40)}\" AKIA{''.join(rng.choices('ABCDEFGHJK234567', k=16))}" for _ in range(200)]
    lines += [" ".join("".join(rng.choices(["th", "er", "on", "an", "ing"], k=8)) for _ in range(20)) for _ in range(200)]
    fresh = hexes(24)
    lines.append(f"bare {fresh} here; secret: short; token=secret : longvalue123")
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    scanner = secrets.fit(d)
    out = {r.doc_id: r for r in secrets.scan(d, scanner).collect()}
    assert all(out[i].n_assign == 2 and out[i].n_access == 1 and out[i].n_hex == 1 for i in range(200))
    assert out[400].spans == "learned:5:29" and out[400].n_assign == 0
    assert sum(out[i].n_learned for i in range(200, 400)) == 0
    first = secrets.base_spans(lines[0])
    joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in first)
    assert out[0].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert all(lines[0][a:b] for a, _, b in first)
    odd = secrets.find_secrets(docs).collect()
    assert len(odd) == docs.count() and secrets.find_secrets(none).count() == 0


def test_shards(docs, none):
    owner = sharding.lookup_table([f"s{i}" for i in range(7)], 1009)
    shares = Counter(owner.tolist())
    assert len(shares) == 7 and max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 1009)
    moved = sum(a != b for a, b in zip(owner.tolist(), fewer.tolist()) if a != 6)
    assert moved < 1009 // 4
    placed = sharding.place(docs)
    rows = placed.collect()
    assert placed.columns == [*docs.columns, "shard"] and len(rows) == docs.count()
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1 and all(0 <= r.shard < sharding.SHARDS for r in rows)
    assert sharding.place(none).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], 1000)


def test_language_model(docs, none):
    rows = texts(docs)
    seq = [(i, [*WORD.findall(lower(t)), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    uni, pair, hist = Counter(), Counter(), Counter()
    for i, s in seq:
        if not held(i):
            uni.update(s)
            pair.update(zip(["<", *s], s))
            hist.update(["<", *s[:-1]])
    stats = {f"u{r}": sum(c == r for c in uni.values()) for r in range(1, 7)} | {f"b{r}": sum(c == r for c in pair.values()) for r in range(1, 7)}
    total, docs_ = sum(uni.values()), uni[None]
    w = lm.Weights(stats | {"tokens": total, "words": len(uni), "docs": docs_})
    low = lambda x: float(w.unigram(np.array([uni[x]]))[0])
    assert abs(sum(map(low, uni)) + w.unknown - 1) < 1e-9
    stored = {}
    for (h, x), c in pair.items():
        if c >= lm.LEAST:
            stored.setdefault(h, {})[x] = float(w.bigram(np.array([c]))[0])
    den = {h: hist[h] + (sum(x.values()) >= hist[h] - 1e-9) for h, x in stored.items()}
    alpha = {h: (1 - sum(x.values()) / den[h]) / (1 - sum(map(low, x))) for h, x in stored.items()}
    p = lambda h, x: stored[h][x] / den[h] if x in stored.get(h, ()) else alpha.get(h, 1.0) * low(x)
    for h in list(stored)[:5]:
        assert abs(sum(p(h, x) for x in uni) + alpha[h] * w.unknown - 1) < 1e-9
    want = []
    for i, s in seq:
        base = sum(math.log10((uni[x] + 1) / (total + len(uni) + 1)) for x in s)
        want.append((-1 if i is None else i, held(i), len(s), sum(uni[x] > 0 for x in s), total, round(base, 5), round(sum(math.log10(p(h, x)) for h, x in zip(["<", *s], s)), 5)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm.score_documents(docs).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3 and abs(a[6] - b[6]) < 1e-3
    assert lm.score_documents(none).count() == 0


def test_language_model_keeps_bigrams_seen_once(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    a, b = [i for i in range(40) if held(i)][:2]
    once = "one time only these nine words stand in a row".split()
    rows = [(i, f"w{i} x{i} y{i} w{i} common words") for i in range(40) if not held(i)] + [(50, " ".join(once))]
    d = spark.createDataFrame([*rows, (a, " ".join(once)), (b, " ".join(once[::-1]))], "doc_id long, text string")
    assert not held(50)
    got = {r.doc_id: r.score for r in lm.score_documents(d).collect()}
    assert got[a] > got[b] + 1  # the same words; only pairs seen once tell the two apart


def test_language_model_counts_beyond_32_bits():
    import pyarrow as pa

    b, one = lm.Block([pa.array(["a b"])], np.array([True])), 2**31 - 1
    h, w = b.names, b.w[np.repeat(np.arange(len(b.names)), b.run)]
    group = pa.table({
        "bucket": [0, 0, 0], "block": [0, 1, 2], "h": [h.tobytes()] * 3, "run": [lm._pack(b.run)] * 3,
        "w": [lm._short(w)] * 3, "n": [lm._pack(np.full(len(w), one))] * 3,
    })
    for r in lm.count_range(group, 4).to_pylist():
        if r["kind"] == "answer":
            assert lm._unpack(r["ch"]).tolist() == lm._unpack(r["chw"]).tolist() == [3 * one] * 3
    many = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 2**62])
    assert (lm._unpack(lm._pack(many)) == many).all() and not len(lm._unpack(lm._pack(many[:0])))


def test_decontamination(spark, docs, none):
    items = [(1, "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa."), (2, None), (3, ""), (4, "lone"), (5, "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa.")]
    q = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, source string")
    filler = docs.where("doc_id = 10").first().text
    rows = [(1, filler[:900] + " alpha BETA gamma, delta epsilon zeta eta theta iota kappa " + filler[900:]), (2, "alpha beta gamma delta epsilon and no answer"), (3, None), (4, "a lone word"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination.find_leaks(d, q).collect()} == {(1, 1), (1, 5), (4, 4), (None, 1), (None, 5)}
    assert [r.doc_id for r in contamination.drop_leaks(d, q).orderBy("doc_id").collect()] == [2, 3]
    assert contamination.drop_leaks(docs, q).columns == docs.columns
    assert contamination.find_leaks(none, q).count() == 0 and contamination.find_leaks(d, q.limit(0)).count() == 0


def long_item(seed, n, last=1 / 3):
    """A question and an answer of ``n`` tokens together; every other token is a common word."""
    rng = random.Random(seed)
    w = [f"{'c' if i % 2 else f'i{seed}x'}{rng.randrange(9 if i % 2 else 10**6)}" for i in range(n)]
    cut = n - int(n * last)
    return " ".join(w[:cut]) + ". " + " ".join(w[cut:]) + "."


def test_decontamination_finds_long_items(spark):
    sizes = (48, 49, 59, 100, 129, 300, 1000)
    items = [(n, long_item(n, n)) for n in sizes]
    filler = [f"c{i % 9}" if i % 2 else f"f{i}" for i in range(2000)]
    rows, want = [], set()
    for n, text in items:
        for offset in (0, 1, 17, 24, 31, 500):
            rows.append((len(rows), " ".join([*filler[:offset], text, *filler[offset : offset + 40]])))
            want.add((len(rows) - 1, n))
        rows.append((len(rows), text[: text.index(".")] + " " + " ".join(filler)))  # the question alone
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination.find_leaks(d, q).collect()} == want
    assert contamination.drop_leaks(d, q).count() == len(sizes)


def test_decontamination_verifies_every_passage(spark):
    text = long_item(5, 59, 9 / 59)
    question = text[: text.index(".")]
    filler = [f"f{i}" for i in range(900)]
    rows = []
    for offset in range(300, 332):  # the copy straddles passages; the question alone lies in one, before or behind
        copy = [*filler[160:offset], text, *filler[offset:600]]
        alone = [*filler[600:632], question, *filler[632:760]]
        rows += [(len(rows), " ".join([*alone, *copy])), (len(rows) + 1, " ".join([*copy, *alone]))]
    rows.append((-1, " ".join(alone)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = contamination.find_leaks(d, q).collect()
    assert sorted(r.doc_id for r in got) == list(range(64))
    assert [r.doc_id for r in contamination.drop_leaks(d, q).collect()] == [-1]


def test_wand_equals_full_scores():
    rng = random.Random(8)
    items = [(i, " ".join(f"t{rng.randrange(80)}" for _ in range(rng.randrange(1, 25)))) for i in range(120)]
    index = contamination.Index(items, 0.4)
    for _ in range(200):
        terms = sorted(rng.sample(index.vocabulary.tolist(), 30))
        scores = Counter()
        for t in terms:
            for item, v in zip(*index.postings[t][:2]):
                scores[item] += v
        assert {i for i, _ in index.search(terms)} == {i for i, v in scores.items() if v >= index.threshold}


def test_pipeline(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small)
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert out.columns == [*columns, "shard"] and out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_a_hot_id_leaves_the_unlabelled_sample_whole(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UNLABELLED", 60)
    first = {r.id: r.h for r in spark.range(500).selectExpr("id", "xxhash64(id, 3) AS h").collect()}
    hot = min((i for i in range(500) if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: first[i])
    rows = [(hot, f"text {k}") for k in range(2000)] + [(i, f"plain words {i}") for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(400)] + [(10_000, 1)], "doc_id long, toxic int")
    chosen = [tuple(r) for r in toxicity.choose(d, m)[0].collect()]
    assert len({i for i, p in chosen if not p}) == 60 and len(chosen) == len(set(chosen))
    assert (hot, 0) in chosen and 10_000 not in {i for i, _ in chosen}
    assert toxicity.score_toxicity(d, m).count() == len(rows)
