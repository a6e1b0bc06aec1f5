"""Near-duplicate names against brute force."""

import random

from citelake.operators import dedupe, groups


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near(a, b):
    a, b = a.split(), b.split()
    left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    if len(a) != len(b) or len(left) != 1 or len(right) != 1:
        return False
    x, y = left[0], right[0]
    return min(len(x), len(y)) >= 4 and x.isalpha() and y.isalpha() and one_edit(x, y)


def test_links_are_all_single_errors(spark):
    rng = random.Random(5)
    words = ["procedimiento", "comun", "ley", "39/2015", "39/2016", "civil", "penal", "aaaa", "aaaaa", "aaaaaa"]
    prints = set()
    for _ in range(250):
        w = rng.sample(words, rng.randrange(1, 4))
        k = rng.randrange(len(w))
        i = rng.randrange(len(w[k]))
        w[k] = rng.choice([w[k], w[k][:i] + w[k][i + 1 :], w[k][:i] + "x" + w[k][i:], w[k][:i] + "q" + w[k][i + 1 :]])
        prints.add(" ".join(sorted({x for x in w if x})))
    prints = sorted(p for p in prints if p)
    edges = [tuple(r) for r in dedupe.name_links(spark.createDataFrame([(p,) for p in prints], "fingerprint string")).collect()]
    assert all(near(a, b) for a, b in edges)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.node: r.root for r in groups.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_names_meet_despite_case_order_accents_and_one_error(spark):
    names = ["Ley de Procedimiento Común", "ley PROCEDIMIENTO comun", "Común Procedimiento, Ley", "Ley de Procedimento Común", None, "", "Ley 39/2015", "Ley 39/2016", "Ley de Procedimento Común"]
    rows = dedupe.near_names(spark.createDataFrame([(n,) for n in names], "law string"), "law").collect()
    assert {(r.name, r.spellings, r.mentions) for r in rows} == {
        ("Ley de Procedimento Común", 4, 5), ("", 1, 1), ("Ley 39/2015", 1, 1), ("Ley 39/2016", 1, 1), (None, 1, 1)
    }
    assert dedupe.near_names(spark.createDataFrame([], "law string"), "law").count() == 0


def test_connected_long_path(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(3, 3), (7, 5), (5, 6)]
    got = {r.node: r.root for r in groups.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 6: 5, 7: 5}
