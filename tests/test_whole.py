"""Documents to mentions, consensus and contexts, against results worked out by hand."""

from pyspark.sql import functions as F

from citelake.functions.text import strip_tags
from citelake.operators import consensus, dedupe, extract, resolve, whole
from citelake.plans.queries import TEXT_WIDTH


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_three_laws_found_by_all_profiles(spark):
    rows = docs(spark, "Según la Ley 39/2015, la Ley 40/2015 y la Ley 1/2000.")
    got = consensus.consensus(whole.found_mentions(rows)).first()
    assert (got["agents_present"], got["distinct_keys"], got["total_consensus"]) == (3, 3, 3)


def test_articles_go_with_their_law_and_acts_are_found(spark):
    text = "artículo 5 de la Ley 39/2015 y artículo 5 de la Ley 40/2015, y el RGPD, art. 6 del Reglamento (UE) 2016/679"
    rows = whole.accepted(whole.found_mentions(docs(spark, text))).collect()
    keys = [r["key"] for r in rows]
    assert sorted(k for k in keys if k.endswith(":art5")) == ["BOE:BOE-A-2015-10565:art5", "BOE:BOE-A-2015-10566:art5"]
    assert sorted(k for k in keys if k.startswith("32016r")) == ["32016r0679", "32016r0679:art6"] and len(keys) == len(set(keys))
    assert all(r["validated"] and r["reason"] is None for r in rows if r["celex"])


def test_bare_articles_take_the_principal_law_or_stay_apart(spark):
    rows = docs(spark, "Ley 39/2015. Véase el artículo 7.", "artículo 7 y otra vez artículo 7", "")
    got = {(r["doc_id"], r["key"]) for r in whole.accepted(whole.found_mentions(rows)).collect() if r["kind"] == "articulo"}
    assert got == {(0, "BOE:BOE-A-2015-10565:art7"), (1, ":art7@0"), (1, ":art7@22")}


def test_text_or_law_on_three_profiles_at_one_place(spark):
    rows = extract.extract(docs(spark, "Ley 39/2015 y luego Ley 40/2015; otra vez Ley 39/2015"))
    kept = dedupe.dedupe_text_or_law(rows).orderBy("start").collect()
    assert [(r["agent"], r["text"], r["start"]) for r in kept] == [("A", "Ley 39/2015", 0), ("A", "Ley 40/2015", 20)]


def test_decree_laws_are_no_laws(spark):
    texts = ["Real Decreto-ley 1/2000", "Real Decreto Ley 1/2000", "Real  Decreto -  Ley 1/2000"]
    got = whole.found_mentions(docs(spark, *texts)).collect()
    assert got and not [r for r in got if r["validated"] or r["boe_id"]]
    assert {(r["doc_id"], r["agent"]) for r in got if r["doc_id"] < 2} == {(d, a) for d in (0, 1) for a in "ABC"}
    assert {r["law_norm"] for r in got if r["doc_id"] < 2} == {"Real Decreto-ley 1/2000"}


def test_context_is_that_of_the_own_place(spark):
    rows = docs(spark, "Ley 39/2015 " + "x" * 40 + " Ley 39/2015 fin")
    got = extract.with_context(rows, 3).where("agent = 'A'").orderBy("start").collect()
    assert [r["place"] for r in got] == [1, 54]
    assert [r["context"] for r in got] == ["Ley...", "...xx Ley..."]


def test_entities(spark):
    raw = "Constituci&oacute;n &#233; &#xE9; &euro; &amp;lt; &nada; &#0; A&B &"
    got = docs(spark, raw).select(strip_tags(F.col("text")).alias("t")).first()["t"]
    assert got == "Constitución é é € &lt; &nada; &#0; A&B &"


def test_batches_number_mentions_of_one_place_alike(spark):
    rows = extract.extract(docs(spark, "Ley 39/2015 Ley 40/2015"))
    numbered = resolve.batches(rows, 10, TEXT_WIDTH).orderBy("idx").collect()
    assert [r["agent"] for r in numbered] == ["A", "B", "C", "A", "B", "C"]


def test_alias_chains_end_when_nothing_is_new(spark):
    found = spark.createDataFrame([(1, "k0", 1)], "doc_id long, key string, rung int")
    edges = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(8)], "key string, next string")

    def expand(newest):
        return newest.join(edges, "key").select("doc_id", F.col("next").alias("key"))

    assert dedupe.converge(found, 1, expand).count() == 9


def test_reports_read_their_enriched_mentions_from_one_table(spark, sf_dir):
    from citelake.plans.queries import QUERIES

    for name in ("report_markdown_enriched", "report_text_inferred"):
        assert not [f for f in QUERIES[name](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_validation_is_worked_out_once_per_distinct_mention(spark, monkeypatch):
    rows = docs(spark, *["Según la Ley 39/2015, artículo 5 de la Ley 40/2015 y el RGPD, artículo 7."] * 20)
    sizes, real = [], whole.registry.validate_mentions
    monkeypatch.setattr(whole.registry, "validate_mentions", lambda m, *a: sizes.append(m.count()) or real(m, *a))
    found = whole.found_mentions(rows).collect()
    assert len(sizes) == 1 and sizes[0] * 20 <= len(found)
    assert len({r["mention_id"] for r in found}) == len(found) and len({(r["key"], r["law"], r["text"]) for r in found}) <= sizes[0]


def test_rules_see_each_distinct_stretch_once(spark, monkeypatch):
    rows = docs(spark, *["Según la Ley 39/2015 y nada más; artículo 5 de la Ley 40/2015. Y el RGPD, según la Ley 39/2015."] * 20)
    seen, real = [], extract.extract
    monkeypatch.setattr(extract, "extract", lambda d, *a, **k: seen.append((d.count(), d.select("text").distinct().count())) or real(d, *a, **k))
    found = whole.found_mentions(rows).collect()
    assert seen == [(4, 4)]  # the last one ends with a full stop
    assert sorted({r["start"] for r in found if r["text"] == "Ley 39/2015"}) == [9, 83]
    assert len(found) % 20 == 0 and len({r["mention_id"] for r in found}) == len(found)


def test_a_long_stretch_does_not_travel_with_its_mentions(spark):
    rows = docs(spark, "Ley 39/2015 " * 3_000, "Ley 40/2015")
    parts = extract.stretches(rows)
    assert parts.selectExpr("max(length(text))").first()[0] > 30_000
    strings = [F.max(F.length(c)) for c, kind in whole._hits(parts).dtypes if kind == "string"]
    assert max(whole._hits(parts).select(F.greatest(*strings)).first()) < 100
    got = whole.found_mentions(rows).groupBy("doc_id", "agent").count().collect()
    assert sorted(map(tuple, got)) == [(d, a, n) for d, n in ((0, 3_000), (1, 1)) for a in "ABC"]
