"""Stored tables with one row per key, and intake that takes each document once."""

import glob
import os
import time
import uuid

from pyspark.sql import functions as F

from citelake.session import checkpoint_dir
from citelake.sources import cache
from citelake.streaming import intake

SCHEMA = "cache_key bigint, value int, ts timestamp, event_id bigint"


def folder(spark):
    return f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def lookups(spark, *rows):
    return spark.createDataFrame(rows, "cache_key bigint, value int, ts string, event_id bigint").withColumn("ts", F.col("ts").cast("timestamp"))


def test_a_merge_rewrites_only_the_buckets_it_touches(spark):
    path = folder(spark)
    table = cache.stored_cache(spark, path, SCHEMA, 16)
    assert table.read().count() == 0
    table.merge(lookups(spark, *[(k, k, "2024-01-02", k) for k in range(200)]))
    before = files(path)
    table.merge(lookups(spark, (7, 70, "2024-01-03", 900), (7, 71, "2024-01-01", 901), (None, 1, "2024-01-01", 1)))
    after = files(path)
    assert len(before) == 16 and sum(f in after for f in before) >= 14
    got = {r.cache_key: (r.value, r.event_id) for r in table.read().collect()}
    assert len(got) == 201 and got[7] == (70, 900) and got[8] == (8, 8) and got[None] == (1, 1)


def test_order_and_repetition_do_not_matter(spark):
    parts = [lookups(spark, (1, 1, "2024-01-01", 1), (2, 5, "2024-01-05", 9)), lookups(spark, (1, 2, "2024-01-01", 2)), lookups(spark, (2, 4, "2024-01-04", 3), (3, 3, None, 4))]
    results = []
    for order in ((0, 1, 2), (2, 1, 0, 1, 2, 0)):
        table = cache.stored_cache(spark, folder(spark), SCHEMA, 4)
        for i in order:
            table.merge(parts[i])
        table.merge(parts[0].limit(0))
        results.append(sorted((r.cache_key, r.value) for r in table.read().collect()))
    assert results[0] == results[1] == [(1, 2), (2, 5), (3, 3)]


DOCS = "doc_id bigint, text string, extra int"


def write(spark, path, name, rows):
    out = folder(spark)
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(out)
    os.makedirs(path, exist_ok=True)
    os.rename(glob.glob(f"{out}/part-*.parquet")[0], f"{path}/{name}.parquet")


def test_documents_are_taken_once_however_they_arrive(spark):
    path, base = folder(spark), folder(spark)
    write(spark, path, "a", [(1, "one", 1), (1, "one", 2), (2, "two", 1), (None, "none", 1), (3, None, 1)])

    def run():
        docs = intake.files_as_they_come(spark, path, DOCS, "*.parquet")
        return sorted(((r.doc_id, r.text) for r in intake.take_in(docs, lambda d: d, base, 4).collect()), key=repr)

    first = sorted([(1, "one"), (2, "two"), (None, "none"), (3, None)], key=repr)
    assert run() == first
    write(spark, path, "b", [(1, "one", 5), (1, "other", 1), (4, "four", 1), (4, "four", 1)])
    old = time.time() - 400 * 86400
    os.utime(f"{path}/b.parquet", (old, old))
    assert run() == sorted([*first, (1, "other"), (4, "four")], key=repr)
    assert run() == sorted([*first, (1, "other"), (4, "four")], key=repr)


def test_a_batch_that_runs_again_finds_its_documents_new(spark):
    seen = intake.seen_documents(spark, folder(spark), buckets=4)
    batch = spark.createDataFrame([(1, "one", 1), (2, "two", 1)], DOCS)
    assert intake.once_only(batch, 3, seen).count() == 2
    assert intake.once_only(batch, 3, seen).count() == 2
    assert intake.once_only(batch, 4, seen).count() == 0
