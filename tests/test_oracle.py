"""Queries against their DuckDB twins on the smallest tables, and rules all queries keep."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import check

QUICK = [
    "extract_all_profiles", "extract_article_law", "explode_multi_article", "dedupe_exact", "dedupe_canonical", "round_history",
    "resolve_anaphora", "resolve_prev_article", "normalize_eu", "expand_acronyms", "registry_lookup", "registry_year_range",
    "validate_articles", "article_text_lookup", "law_articles_flat", "concept_to_articles", "html_clean_text", "html_outline",
    "html_articles", "eu_articles", "consensus", "agreement_metrics", "audit_report", "coverage_cube", "report_markdown",
    "report_json", "model_requests", "model_responses_parse", "inferred_new_only", "rate_window_count", "job_stats", "top_cited_laws",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, con, sf_dir, name):
    assert check.compare(spark, con, sf_dir, name).startswith("ok")


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) - set(entry.oracle_sql()) == {"file_manifest"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["boe_id", "mentions", "docs"] and df.count() > 0


@pytest.mark.parametrize("name", ["extract_all_profiles", "validate_mentions", "registry_year_range", "concept_to_articles", "agreement_matrix", "law_hierarchy"])
def test_no_pairwise_plans(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_library_rules():
    paths = glob.glob(os.path.join(os.path.dirname(entry.__file__), "citelake/**/*.py"), recursive=True)
    assert paths
    for path in paths:
        source = open(path, encoding="utf-8").read()
        assert "localCheckpoint" not in source and ".collect()" not in source and "crossJoin" not in source
        assert not re.search(r"\bF\.udf\b", source)
