"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line.

``scaling`` is each query's time there over its time on ``$BENCH_SMALL_DIR`` (the ``sf0.01`` beside it).
"""

from __future__ import annotations

import json
import os
import time

from citelake.plans.queries import QUERIES
from citelake.session import build_session

HEADLINE = [
    "extract_all_profiles", "extract_article_law", "mention_context", "html_clean_text", "html_articles",
    "dedupe_exact", "dedupe_text_or_law", "dedupe_semantic", "converge_mentions", "resolve_anaphora",
    "resolve_prev_article", "normalize_mentions", "registry_lookup", "registry_year_range", "validate_articles",
    "validate_mentions", "article_text_lookup", "law_articles_flat", "concept_to_articles", "consensus",
    "agreement_metrics", "audit_grade", "audit_report", "corpus_summary", "detect_concepts", "inferred_new_only",
    "report_markdown", "model_responses_parse", "rate_window_count", "rate_admission", "stream_extract", "top_cited_laws",
]


def timed(spark, names: list[str], sf_dir: str) -> dict[str, float]:
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("OFF")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the engine
    seconds = timed(spark, names, sf_dir)
    small = os.environ.get("BENCH_SMALL_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01"))
    scaling = {}
    if os.path.isdir(small) and os.path.abspath(small) != os.path.abspath(sf_dir):
        scaling = {name: round(seconds[name] / spent, 2) for name, spent in timed(spark, names, small).items()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    mentions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rates = {}
    if "extract_all_profiles" in seconds:
        rates["documents_per_sec"] = round(docs / seconds["extract_all_profiles"], 1)
    for name in ("consensus", "dedupe_exact", "audit_grade"):
        if name in seconds:
            rates[f"mentions_per_sec_{name}"] = round(mentions / seconds[name], 1)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rates": rates, "scaling": scaling, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
