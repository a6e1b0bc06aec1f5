"""Places of mentions against the expression that searches one mention in one text."""

import random

from pyspark.sql import functions as F

from citelake.operators import extract, locate


def test_places():
    text = "Art. 5 C.E. y la LEY 39/2015; el art 5 CE; Ley\n40/2015 (a+b)"
    wanted = ["ley 39/2015", "art. 5 C.E.", "art. 5  CE", "Ley 40/2015", "(A+B)", "nada", "", "y", "la ley", ".", "C.E."]
    assert locate.places(text, wanted) == [17, 0, -1, 43, 55, -1, -1, 12, 14, 3, 7]
    assert locate.places("", wanted) == [-1] * len(wanted) and locate.places(text, []) == []
    assert locate.places("xİy LEC", ["lec", "İy"]) == [4, 1]


def test_against_one_by_one_search(spark):
    rng = random.Random(3)
    docs, mentions = [], []
    for i in range(30):
        words = [rng.choice(["Ley", "ley", "39/2015", "art.", "art", "C.E.", "CE", "de", "  ", "5"]) for _ in range(rng.randrange(0, 60))]
        docs.append((i, " ".join(words)))
        mentions += [(i, " ".join(rng.choices(["Ley", "39/2015", "art.", "C.E.", "5", "de"], k=rng.randrange(1, 4)))) for _ in range(rng.randrange(0, 9))]
    docs += [(100, None), (101, "Ley 1"), (102, "Ley 1")]
    mentions += [(100, "Ley"), (101, None), (999, "Ley"), (102, "Ley 1"), (102, "Ley 1")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = spark.createDataFrame(mentions, "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.place, r.context) for r in locate.locate(d, m, 10).collect()}
    pairs = m.where("text is not null").distinct().withColumnRenamed("text", "m").join(d, "doc_id")
    body = F.coalesce("text", F.lit(""))
    want = pairs.select("doc_id", "m", extract.position_in(body, F.lower(body), F.col("m")).alias("p"), body.alias("t"))
    want = want.select("doc_id", "m", "p", extract.context_window(F.col("t"), F.col("p"), 10).alias("c")).collect()
    assert got == {(r.doc_id, r.m): (r.p, r.c) for r in want} and len(got) > 60
    assert locate.locate(d, m.limit(0)).count() == 0


def test_many_mentions_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(locate, "LISTED", 50)
    text = " ".join(f"Ley {i}/2015" for i in range(400))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    m = spark.createDataFrame([(1, f"Ley {i}/2015") for i in range(800)], "doc_id long, text string")
    got = {r.text: r.place for r in locate.locate(d, m).collect()}
    assert got == {f"Ley {i}/2015": text.find(f"Ley {i}/2015") + 1 for i in range(800)}
