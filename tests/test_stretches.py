"""Rules tried on the stretches of a text find what they find in the whole text."""

import random

from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.text import FOLD, find_in, mark, prepare
from citelake.operators import extract

HEADS = [
    "Ley", "LEY", "Real", "Decreto", "Decreto-", "Decreto-ley", "RD", "RDL", "art.", "art", "artículo", "articulo", "Constitución", "Código",
    "LPAC", "LRJSP", "LEC", "LECrim", "LJCA", "CE", "CC", "LAECSP", "Reglamento", "Directiva", "Decisión", "Decisión Marco", "İA Act",
    *dims.EU_ACRONYMS,
]
MORE = [
    "Orgánica", "39/2015", "2016/679", "1/20", "5", "5.2", "5.2.b", "de", "la", "del", "Española", "Civil", "Penal", "Legislativo", "-", "--",
    "(UE)", "(CE)", "UE", "(", ")", "Nº", "No.", "n.º", "y", "x", "según", "place", "fire", "é", "́", "漢字", "😀", ",", ".", "İ",
]
GAPS = [" ", " ", " ", " ", "", "  ", "\n", "\t", " ", "          ", "(", "\u0001", "\u000b"]


def texts(n, seed):
    deal = random.Random(seed)
    out = []
    for i in range(n):
        words = [deal.choice(HEADS if deal.random() < 0.4 else MORE) for _ in range(deal.randrange(1, 40))]
        out.append((i, "".join(deal.choice([w, w, w.upper(), w.lower()]) + deal.choice(GAPS) for w in words)))
    return out


def plain(docs, pattern):
    marked = docs.select("doc_id", mark(prepare(F.col("text")), FOLD + pattern).alias("p"))
    return sorted(tuple(r) for r in marked.select("doc_id", F.inline(find_in(F.col("p")))).collect())


def test_stretches_lose_and_add_nothing(spark):
    docs = spark.createDataFrame([*texts(3000, 7), (9000, None), (9001, ""), (9002, "x" * 50_000), (9003, "Ley 1/2000 " * 2_000)], "doc_id long, text string").cache()
    parts = extract.stretches(docs).cache()

    def of(found):
        return sorted(tuple(r) for r in found.select("doc_id", "start", "text").collect())

    assert of(extract.extract_eu(parts)) == plain(docs, extract.EU_ACT)
    assert of(extract.extract_article_law(parts)) == plain(docs, extract.ARTICLE_LAW)
    want = []
    for _, _, pattern, *_ in dims.PROFILE_PATTERNS:
        want += plain(docs, (extract._OWN_TYPE if pattern.startswith("Ley") else "") + pattern)
    assert of(extract.extract(parts)) == sorted(want)


def test_every_rule_is_tried_on_stretches_alone(spark):
    docs = spark.createDataFrame([(1, "Según la Ley 39/2015 " + "y nada más " * 1000)], "doc_id long, text string")
    assert [tuple(r) for r in extract.stretches(docs).select("at", "text").collect()] == [(9, "Ley 39/2015")]
    for found in (extract.extract(docs), extract.extract_eu(docs), extract.extract_article_law(docs), extract.with_context(docs)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?=[aAcCdDlLpPrR])") == 1


def test_normalize_mentions_reads_its_stretches_from_a_table(spark, sf_dir):
    from citelake.plans.queries import QUERIES

    assert not [f for f in QUERIES["normalize_mentions"](spark, sf_dir).inputFiles() if "documents" in f]


def test_whole_way_walks_its_texts_once(spark, monkeypatch):
    from citelake.operators import whole

    docs = spark.createDataFrame([(1, "art. 5 de la Ley 39/2015 y el RGPD")], "doc_id long, text string")
    calls, real = [], extract.stretches
    monkeypatch.setattr(extract, "stretches", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert whole.found_mentions(docs).count() > 0 and len(calls) == 1


def test_rules_are_tried_where_their_first_letters_are(spark):
    docs = spark.createDataFrame([(1, "LEC")], "doc_id long, text string")
    plan = extract.extract(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(__lower" in plan or "Contains(" in plan or "contains(" in plan.lower()
