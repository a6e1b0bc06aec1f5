"""Consensus and audit demos, and their invariants on the given tables."""

import duckdb
from pyspark.sql import functions as F

from citelake.operators import audit, consensus, dedupe, report
from citelake.plans import fixtures as fx


def test_comparator_demo(spark):
    rows = [("A", "Ley 39/2015", None), ("A", "Ley 40/2015", None), ("A", "Constitución Española", "24"),
            ("B", "Ley 39/2015", None), ("B", "Ley 40/2015", None), ("B", "Ley 1/2000", None)]
    df = spark.createDataFrame([(1, a, law, art, None) for a, law, art in rows], "doc_id long, agent string, law string, article string, boe_id string")
    keyed = dedupe.with_key(df)
    assert {r["key"] for r in keyed.collect()} == {"ley39/2015", "ley40/2015", "constituciónespañola:art24", "ley1/2000"}
    level = consensus.consensus(keyed).first()
    assert (level["total_consensus"], level["partial_consensus"], level["agents_present"]) == (2, 0, 2)
    assert {r["agent"]: r["unique_keys"] for r in consensus.unique_by_agent(keyed).collect()} == {"A": 1, "B": 1}
    m = consensus.agreement_metrics(keyed).first()
    assert (m["agreement"], m["coverage_a"], m["coverage_b"], m["coverage_c"]) == (50.0, 100.0, 100.0, None)


def demo(spark):
    rows = [("Ley 39/2015", "ley", 100, True, "BOE-A-2015-10565"), ("Ley 40/2015", "ley", 100, True, "BOE-A-2015-10566"),
            ("artículo 24", "articulo", 90, False, None), ("Ley 9/9999", "ley", 60, False, None)]
    return spark.createDataFrame(
        [(1, f"m{i}", "A", t, k, c, v, b, i) for i, (t, k, c, v, b) in enumerate(rows)],
        "doc_id long, mention_id string, agent string, text string, kind string, confidence int, validated boolean, boe_id string, start long",
    )


def test_auditor_demo(spark):
    row = audit.audit(demo(spark)).first()
    assert (row["mean_confidence"], row["high"], row["medium"], row["low"], row["rate"]) == (87.5, 3, 0, 1, 0.5)
    assert (row["grade"], row["level"]) == (6.3, "Bueno")
    assert [p["problem"] for p in row["problems"]] == ["pocas_referencias"]


def test_convergence_problem(spark):
    flags = spark.createDataFrame([(1, False)], "doc_id long, converged boolean")
    names = [r["problem"] for r in audit.audit_problems(demo(spark), flags).collect()]
    assert names == ["sin_convergencia", "pocas_referencias"]


def test_invariants(spark, sf_dir):
    facts = fx.mention_facts(spark, sf_dir)
    keyed = dedupe.with_key(facts)
    profile = audit.audit_confidence(facts)
    assert profile.where(F.col("high") + F.col("medium") + F.col("low") != F.col("total")).isEmpty()
    unique = consensus.unique_by_agent(keyed).groupBy("doc_id").agg(F.sum("unique_keys").alias("u"))
    levels = consensus.consensus(keyed).join(unique, "doc_id", "left").fillna(0, ["u"])
    several = levels.where(F.col("agents_present") > 1)
    assert several.where(F.col("total_consensus") + F.col("partial_consensus") + F.col("u") != F.col("distinct_keys")).isEmpty()


def test_report_order_on_disk(spark, tmp_path, sf_dir):
    blocks = report.report_markdown(fx.mention_facts(spark, sf_dir).where(F.col("boe_id").isNotNull()), "hoy", 100_000_000_000_000)
    report.write_report(blocks, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    heads = [x for x in lines if x.startswith("**Tema:** ")]
    assert len(heads) == len(set(heads)) == blocks.select("doc_id").distinct().count()


def test_ratio_is_rounded_as_its_sql_does(spark):
    ties = [(41, 640), (82, 1280), (323, 640), (333, 640), (1, 128)]
    rows = [(b * 1000 + a, "ley" if i < a else "articulo") for a, b in ties for i in range(a + b)]
    got = {r.doc_id: r.law_article_ratio for r in audit.audit_coverage(spark.createDataFrame(rows, "doc_id long, kind string")).collect()}
    con = duckdb.connect()
    assert got == {b * 1000 + a: con.sql(f"SELECT round({a} / {b}, 6)").fetchall()[0][0] for a, b in ties}
