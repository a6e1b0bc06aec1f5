"""De-duplication against the one-by-one rules, on skewed input."""

import random

from pyspark.sql import functions as F

from citelake.operators import dedupe

SCHEMA = "doc_id long, mention_id string, agent string, text string, law string, article string, boe_id string, start long, confidence int"


def mentions(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        doc = 0 if i % 3 == 0 else rng.randint(1, 12)
        law = rng.choice([None, "", "Ley 1/2000", "Ley 2/2000", f"Ley {rng.randint(3, 40)}/2000"])
        text = rng.choice(["", f"t{rng.randint(0, 30)}", f" T{rng.randint(0, 30)} "])
        rows.append((doc, f"m{i}", rng.choice("ABC"), text, law, rng.choice([None, "1", "2"]), None, i, rng.randint(50, 100)))
    rng.shuffle(rows)
    return rows


def test_text_or_law_is_the_sequential_rule(spark):
    rows = mentions()
    got = {r["mention_id"] for r in dedupe.dedupe_text_or_law(spark.createDataFrame(rows, SCHEMA)).collect()}
    want, texts, laws = set(), set(), set()
    for r in sorted(rows, key=lambda r: r[7]):
        text, law = r[3].lower().strip(), (r[4] or "").lower().strip()
        if (text and (r[0], text) in texts) or (law and (r[0], law) in laws):
            continue
        want.add(r[1])
        texts.add((r[0], text))
        laws.add((r[0], law))
    assert got == want


def test_one_set_of_texts_and_laws(spark):
    rows = mentions(seed=9)
    new = [r for r in rows if r[7] >= 100]
    previous = [r for r in rows if r[7] < 100]
    got = {r["mention_id"] for r in dedupe.new_texts_or_laws(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(previous, SCHEMA)).collect()}
    seen = set()
    for r in previous:
        seen |= {(r[0], x) for x in (r[3].lower().strip(), (r[4] or "").lower().strip()) if x}
    want = set()
    for r in sorted(new, key=lambda r: r[7]):
        text, law = r[3].lower().strip(), (r[4] or "").lower().strip()
        if (r[0], text) in seen or (law and (r[0], law) in seen):
            continue
        want.add(r[1])
        seen.add((r[0], text))
        if law:
            seen.add((r[0], law))
    assert got == want


def test_exact_dedupe_is_idempotent_and_ignores_input_order(spark):
    rows = mentions()
    once = dedupe.dedupe_exact(spark.createDataFrame(rows, SCHEMA))
    first = sorted(r["mention_id"] for r in once.collect())
    assert first == sorted(r["mention_id"] for r in dedupe.dedupe_exact(once).collect())
    assert first == sorted(r["mention_id"] for r in dedupe.dedupe_exact(spark.createDataFrame(rows[::-1], SCHEMA)).collect())


def test_semantic_groups(spark):
    rows = [
        (1, "a", "A", "CE art.1", "CE", "1", None, 1, 80), (1, "b", "B", "Constitución Española artículo 1", "Constitución Española", "artículo 1", None, 2, 80),
        (1, "c", "A", "CE art.2", "CE", "2", None, 3, 80),
        (1, "d", "A", "Ley 13/2009", "Ley 13/2009", None, None, 4, 80), (1, "e", "A", "Ley 13/2009, de 3 de noviembre", "Ley 13/2009", None, None, 5, 80),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "identity", F.when(F.col("law").isin("CE", "Constitución Española"), "BOE-A-1978-31229").otherwise(F.col("law"))
    )
    assert sorted(r["mention_id"] for r in dedupe.dedupe_semantic(df).collect()) == ["b", "c", "e"]


def test_convergence(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "c", 3)], "doc_id long, key string, rung int")
    edges = spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "a"), ("c", "c")], "key string, other string")

    def expand(newest):
        return newest.join(edges, "key").select("doc_id", F.col("other").alias("key"))

    got = {(r["doc_id"], r["key"]): r["round"] for r in dedupe.converge(found, 3, expand).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (2, "c"): 3, (1, "x"): 4, (1, "y"): 5}
    short = {r["key"] for r in dedupe.converge(found, 3, expand, max_rounds=4).collect()}
    assert short == {"a", "b", "c", "x"}


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_walk_and_passes_give_the_same_rows_and_the_walk_sends_them_once(spark, monkeypatch):
    df = spark.createDataFrame(mentions(seed=11) + mentions(60, seed=11), SCHEMA)  # some ids twice
    old = df.where("start < 80")
    results = {}
    for walked in (10_000, 60, 0):  # all walked, the large document in passes, all in passes
        monkeypatch.setattr(dedupe, "WALKED", walked, raising=False)
        out = dedupe.dedupe_text_or_law(df), dedupe.new_texts_or_laws(df.where("start >= 80"), old)
        results[walked] = [sorted(map(repr, x.collect())) for x in out]
        if walked == 10_000:
            assert [joins(x) for x in out] == [0, 0]
    assert results[10_000] == results[60] == results[0]
    assert all(results[0])


def test_rows_without_a_document_end(spark):
    rows = [(None, "m0", "A", "t", None, None, None, 1, 90), (1, "m1", "A", "t", None, None, None, 1, 90)]
    assert [r.mention_id for r in dedupe.dedupe_text_or_law(spark.createDataFrame(rows, SCHEMA)).collect()] == ["m1"]
