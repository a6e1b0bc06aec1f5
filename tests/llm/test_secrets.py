"""Secret scans against a plain scan of the base patterns and held-out values of the formats learned."""

import random
import re
import string
import time
from collections import Counter

import pytest

from citelake.llm import secrets

ALNUM = string.ascii_letters + string.digits
FORMATS = {
    "assign": (ALNUM, 40, ""),
    "access": (string.ascii_uppercase + string.digits, 16, "AKIA"),
    "hex": ("0123456789abcdef", 40, ""),
}
SYLLABLES = "ba ko min tra sel dor fi na po ri ten".split()


def value(rng, kind):
    letters, n, head = FORMATS[kind]
    return head + "".join(rng.choice(letters) for _ in range(n))


def name(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(8)) + rng.choice(["", "-x", "_id", ".html", "_2024"])


@pytest.fixture(scope="module")
def scanner():
    rng = random.Random(4)
    return secrets.Scanner({k: [value(rng, k) for _ in range(300)] for k in FORMATS}, [name(rng) for _ in range(3000)])


def test_formats_of_fixed_length_keep_a_state_per_place(scanner):
    assert [len(a.states) for a in scanner.automata] == [41, 21, 41]


@pytest.mark.parametrize("kind", FORMATS)
def test_held_out_values_are_found(scanner, kind):
    rng = random.Random(9)
    found = sum(scanner.ratio(value(rng, kind)) >= scanner.margin for _ in range(500))
    assert found >= 450
    assert not any(scanner.ratio(name(rng)) >= scanner.margin for _ in range(500))


def test_unlabelled_value_behind_a_name(scanner):
    v = value(random.Random(2), "assign")
    text = f"signing_id_of_the_host={v}. Then"
    a = text.index(v)
    assert scanner.spans(text) == ([], [(a, 3, a + 40)])


def test_examples_longer_than_the_tree():
    rng = random.Random(5)
    long = ["".join(rng.choice("0123456789abcdef") for _ in range(128)) for _ in range(200)]
    s = secrets.Scanner({"hex": long}, [name(rng) for _ in range(500)])
    fresh = "".join(rng.choice("0123456789abcdef") for _ in range(128))
    assert s.ratio(fresh) >= s.margin and s.ratio(name(rng) * 4) < 0


def plain_base(text):
    keys = r"(password|passwd|secret|token|api_?key)"
    out = [(m.start(), 0, m.end()) for m in re.finditer(keys + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def noisy(rng, n):
    parts = ["token", "Secret", "API_KEY", "=", ": ", "'", " ", "\n", ".", "--", "==", "AKIA", "password:"]
    draw = [lambda: rng.choice(parts), lambda: value(rng, rng.choice(list(FORMATS))), lambda: name(rng)]
    return "".join(rng.choice(draw)() for _ in range(n))


def test_spans_against_a_plain_scan():
    rng = random.Random(7)
    for _ in range(400):
        text = noisy(rng, 40)
        base = plain_base(text)
        assert secrets.base_spans(text) == base
        want = []
        for m in secrets.CANDIDATE.finditer(text):
            a = m.start() + len(m[0]) - len(m[0].lstrip(".-"))
            b = m.start() + len(m[0].rstrip(".-"))
            if b - a >= 16 and not any(s < b and a < e for s, _, e in base):
                want.append((a, b))
        assert list(secrets.candidates(text, base)) == want


def test_many_secrets_in_one_text(scanner):
    rng = random.Random(3)
    text = " ".join(f"token={value(rng, 'access')} and {value(rng, 'assign')}" for _ in range(50_000))
    began = time.monotonic()
    base, learned = scanner.spans(text)
    assert Counter(k for _, k, _ in base) == {0: 50_000, 1: 50_000} and len(learned) >= 45_000
    assert time.monotonic() - began < 60


def test_choice_by_hash_is_that_of_a_full_sort(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join([f"password={value(rng, 'assign')}", *(name(rng) + str(rng.randrange(10**6)) for _ in range(5))])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(secrets, "EXAMPLES", 50)
    monkeypatch.setattr(secrets, "ORDINARY", 300)
    seen = {}
    monkeypatch.setattr(secrets, "Scanner", lambda examples, ordinary, margin: seen.update(examples, other=ordinary))
    secrets.fit(d)
    from pyspark.sql import functions as F

    words = secrets.labelled(d).distinct().withColumn("h", F.xxhash64("word")).orderBy("h", "word").collect()
    for kind, most in (("assign", 50), ("other", 300)):
        assert seen[kind] == [r.word for r in words if r.kind == kind][:most]
