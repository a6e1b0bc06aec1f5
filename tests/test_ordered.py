"""Blocked scans against plain loops, with one key that holds a third of the rows."""

import random

from pyspark.sql import functions as F

from citelake.operators import ordered


def rows_with_hot_key(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.randint(1, 20)
        out.append((key, i, rng.randint(0, 5000) * 1000 + i, rng.choice([None, None, "a", "b", "c"]), rng.randint(0, 3)))
    rng.shuffle(out)
    return out


SCHEMA = "k int, id int, pos long, v string, x int"


def grouped(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(g, key=lambda r: r[2]) for k, g in groups.items()}


def test_fill_forward(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, SCHEMA)
    for inclusive in (False, True):
        got = {r["id"]: r["out"] for r in ordered.fill_forward(df, ["k"], "pos", F.col("v"), "out", 200_000, inclusive).collect()}
        for group in grouped(rows).values():
            last = None
            for _, i, _, v, _ in group:
                if inclusive and v is not None:
                    last = v
                assert got[i] == last
                if v is not None:
                    last = v


def test_number_rows_and_running_sum(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, SCHEMA)
    numbers = {r["id"]: r["n"] for r in ordered.number_rows(df, ["k"], "pos", "n", 200_000).collect()}
    sums = {r["id"]: r["s"] for r in ordered.running_sum(df, ["k"], "pos", F.col("x"), "s", 200_000).collect()}
    for group in grouped(rows).values():
        total = 0
        for n, (_, i, _, _, x) in enumerate(group, 1):
            total += x
            assert numbers[i] == n
            assert sums[i] == total


def test_trailing_count(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["c"] for r in ordered.trailing_count(df, ["k"], "pos", 60_000, "c").collect()}
    for group in grouped(rows).values():
        for _, i, p, _, _ in group:
            assert got[i] == sum(1 for g in group if p - 60_000 < g[2] <= p)


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5, "a", 0), (None, 2, 9, None, 0), (1, 3, 7, None, 0)], SCHEMA)
    got = {r["id"]: r["out"] for r in ordered.fill_forward(df, ["k"], "pos", F.col("v"), "out", 4).collect()}
    assert got == {1: None, 2: "a", 3: None}


def test_scans_send_their_rows_once_and_nulls_are_a_key(spark):
    rows = [(k, i, i) for k in (None, 1, 2) for i in range(25)]
    df = spark.createDataFrame(rows, "k long, o long, payload long")
    out = ordered.number_rows(df, ["k"], "o", "n", 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(sent) == 4  # the rows; block counts, their scan and their join
    assert sorted((r.k or 0, r.o, r.n) for r in out.collect()) == sorted((k or 0, i, i + 1) for k, i, _ in rows)
