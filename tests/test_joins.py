"""The salted left join against a plain one, with a hot key and null keys."""

from citelake.operators import infer, normalize, registry
from citelake.operators.joins import join_hot, left_join_hot


def test_left_join_hot(spark):
    rows = [(f"m{i}", None if i % 11 == 0 else "hot" if i % 3 else f"k{i}") for i in range(300)]
    answers = [("hot", 1), (None, 2), ("k3", 3)]
    got = left_join_hot(
        spark.createDataFrame(rows, "id string, k string"), spark.createDataFrame(answers, "__k string, v int"), {"k": "__k"}, "id"
    )
    assert got.columns == ["id", "k", "v"]
    known = dict(answers)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(
        ((i, k, known.get(k)) for i, k in rows), key=lambda r: r[0]
    )


def test_join_hot_with_several_answers(spark):
    rows = [(f"m{i}", None if i % 11 == 0 else "hot" if i % 3 else f"k{i}") for i in range(300)]
    answers = [("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)]
    got = join_hot(
        spark.createDataFrame(rows, "id string, k string"), spark.createDataFrame(answers, "__k string, v int"), {"k": "__k"}, "id"
    )
    assert sorted(map(tuple, got.collect())) == sorted((i, k, v) for i, k in rows for a, v in answers if a == k)


def test_concepts_of_a_much_cited_law(spark):
    docs = spark.createDataFrame([(i, "el contrato y la prenda" if i % 2 else "la prenda", ) for i in range(60)], "doc_id long, text string")
    laws = spark.createDataFrame([("contrato", "hot"), ("prenda", "rare"), ("prenda", "hot2"), ("otro", "hot")], "concept string, boe_id string")
    cited = spark.createDataFrame([(i, "hot") for i in range(0, 60, 3)] + [(5, "rare"), (5, "rare"), (None, "hot")], "doc_id long, boe_id string")
    got = infer.detect_concepts(docs, ["contrato", "prenda", "otro"], cited, laws).collect()
    want = {(i, "prenda") for i in range(60) if i != 5} | {(i, "contrato") for i in range(1, 60, 2) if i % 3}
    assert len(got) == len(want) and {(r.doc_id, r.concept) for r in got} == want


def test_acronyms_and_acts_with_null_keys(spark):
    laws = spark.createDataFrame([("LEC", "Ley 1/2000", 1), ("lec", "Ley 9/2009", 2), (None, "Ley 3/2003", 3)], "alias string, law string, ord long")
    mentions = spark.createDataFrame([(f"m{i}", (" lec ", None, "CC")[i % 3]) for i in range(30)], "mention_id string, text string")
    got = {r.mention_id: r.alias_law for r in normalize.acronym_to_law(mentions, laws).collect()}
    assert got == {f"m{i}": ("Ley 1/2000", None, None)[i % 3] for i in range(30)}
    acts = spark.createDataFrame([("32016R0679", "RGPD"), (None, "x")], "celex string, title string")
    texts = ("Reglamento (UE) 2016/679", "Reglamento (UE) 2017/1", "nada")
    eu = spark.createDataFrame([(f"m{i}", texts[i % 3]) for i in range(30)], "mention_id string, text string")
    rows = registry.enrich_eu(eu, acts).collect()
    assert len(rows) == 20 and {(r.text, r.act_exists, r.eu_title) for r in rows} == {(texts[0], True, "RGPD"), (texts[1], False, None)}
