import os

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, k long"


def word(i: int) -> str:
    return "".join("bcdfghklmnprst"[i // 14**p % 14] + "aeiou"[(i >> p) % 5] for p in range(3))


def prose(first: int, n: int) -> str:
    return " ".join(word((first * 37 + i * 101) % 2741) for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, near copies and columns with clashing names."""
    base = prose(3, 200)
    near = base.replace(word((3 * 37 + 100 * 101) % 2741), "changed", 1)
    rows = [
        (1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", "b"), (3, base, "en", "b"), (4, None, "en", "a"),
        (5, "", None, None), (6, " \n\t ", "en", None), (7, "one", "en", "c"), (8, "ONE", "en", "c"), (9, "two words", "en", "c"),
        (10, prose(9, 30_000), "en", "b"), (None, prose(11, 120), None, "a"), (11, "###!! " + "again and again " * 60, "en", "a"),
        *((20 + i, prose(20 + i, 60 + i), "en", "abc"[i % 3]) for i in range(60)),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1) for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, int(i % 4 == 0)) for i in range(20, 80)] + [(11, 0, 0), (None, 1, 1), (20, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else None
