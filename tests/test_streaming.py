"""Streams against their batch twins and against plain loops."""

import random
from collections import deque

from citelake.plans.queries import QUERIES
from citelake.streaming import admission, intake, jobs


def requests(n=500, seed=2):
    rng = random.Random(seed)
    return [(0 if i % 3 == 0 else rng.randint(1, 9), rng.randint(0, 400_000_000), i) for i in range(n)]


def sequential(rows, limit, span):
    held, out = {}, {}
    for client, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        q = held.setdefault(client, deque())
        while q and q[0] <= t - span:
            q.popleft()
        out[i] = len(q) < limit
        if out[i]:
            q.append(t)
    return out


def test_admission(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "client long, t_us long, event_id long")
    got = {r["event_id"]: r["admitted"] for r in admission.admit(df, 3).collect()}
    assert got == sequential(rows, 3, admission.SPAN_US)
    assert not all(got.values())


def test_admission_stream(spark, tmp_path):
    rows = requests(120)
    schema = "client long, t_us long, event_id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r["event_id"]: r["admitted"] for r in intake.run_to_table(admission.admit_stream(stream, 3), "admit").collect()}
    assert got == sequential(rows, 3, admission.SPAN_US)


def test_intake_equals_batch(spark, sf_dir):
    batch = QUERIES["extract_all_profiles"](spark, sf_dir).select("mention_id")
    stream = QUERIES["stream_extract"](spark, sf_dir).select("mention_id")
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).isEmpty()


def test_intake_takes_a_document_once(spark, tmp_path):
    schema = "doc_id long, text string"
    rows = [(1, "Ley 39/2015"), (2, "nada")]
    for name in ("a", "b"):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = intake.arriving(spark, str(tmp_path / "in" / "*"), schema, "*.parquet")
    out = intake.run_to_table(stream.select("doc_id", "text"), "once")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_batch_sessions(spark, sf_dir):
    from citelake.plans import fixtures as fx

    log = fx.job_log(spark, sf_dir)
    sessions = jobs.stream_sessions(log)
    assert sessions.agg({"events": "sum"}).first()[0] == log.count()


def test_intake_takes_files_with_old_times(spark, tmp_path):
    import os
    import uuid

    schema = "doc_id long, text string"
    base = tmp_path / "late"
    out, state = str(base / "out"), str(base / uuid.uuid4().hex)

    def run():
        stream = intake.arriving(spark, str(base / "in" / "*"), schema, "*.parquet").select("doc_id", "text")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            availableNow=True
        ).start().awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(str(base / "in" / "first"))
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], schema).coalesce(1).write.parquet(str(base / "in" / "second"))
    for part in (base / "in" / "second").glob("*.parquet"):
        os.utime(part, (0, 0))
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_stream_queries_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("stream_extract", "stream_cache_upsert", "stream_job_windows"):
        folder, file = QUERIES[query](spark, str(tmp_path)), QUERIES[query](spark, sf_dir)
        assert folder.count() == file.count() > 0
        assert folder.exceptAll(file).isEmpty()


def test_intake_of_nothing_is_empty(spark, tmp_path):
    (tmp_path / "docs.parquet").mkdir()
    docs = intake.table_as_it_comes(spark, str(tmp_path / "docs.parquet"), "doc_id long, text string")
    assert intake.take_in(docs, intake.extract_stream, str(tmp_path / "out"), 2).isEmpty()
