"""Files in, rows out."""

import json

from pyspark.sql import functions as F

from citelake.operators import normalize
from citelake.sources import aliases, cache, files, registry, topics


def test_topics(spark, tmp_path):
    doc = {"document": {"documentVersion": {"contenido": "<h1>T</h1>\n<p>\"x\"</p>"}}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
    assert topics.read_topics(spark, str(tmp_path)).first()["html"] == "<h1>T</h1>\n<p>\"x\"</p>"


def test_rescue(spark):
    rows = [('{"document": {"documentVersion": {"contenido": "ok"}}}',), ('{"contenido": "<p class="x">a</p>"}',), ("?? <h1>a</h1> b <h1>c</h1> ??",), ("nada",)]
    got = [(r["rescued"], r["html"]) for r in topics.rescue_topics(spark.createDataFrame(rows, "json string")).collect()]
    assert got == [("json", "ok"), ("field", '<p class="x">a</p>'), ("heading", "<h1>a</h1> b <h1>c</h1>"), ("none", None)]


def test_text_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("artículo ñ €".encode("utf-8"))
    (tmp_path / "l.md").write_bytes("artículo ñ".encode("latin-1"))
    (tmp_path / "x.bin").write_bytes(b"no")
    got = {r["path"].split("/")[-1]: r["text"] for r in topics.read_text(spark, str(tmp_path)).collect()}
    assert got == {"u.txt": "artículo ñ €", "l.md": "artículo ñ"}


def test_text_to_html(spark):
    df = spark.createDataFrame([("N", "uno\ndos\n\n \n\ntres ")], "n string, t string")
    got = df.select(topics.text_to_html(F.col("n"), F.col("t"))).first()[0]
    assert got == '<div class="documento-estudiante">\n<h1>N</h1>\n<p>uno<br>dos</p><p>tres</p>\n</div>'


def test_manifest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "big.txt").write_bytes(b"x" * 2000)
    got = {r["name"]: (r["content_fits"], r["too_large"]) for r in files.manifest(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {"a.pdf": (True, False), "b.pdf": (False, False), "c.txt": (True, False), "big.txt": (None, True)}


def test_alias_file(spark, tmp_path):
    body = "﻿SIGLAS,SIGNIFICADO,,\napdo.,Apartado,,\nL.E.C.,\"Ley 1/2000, de 7 de enero\",,\nLEC,Ley de Enjuiciamiento Civil,,\n,vacío,,\nLEC,Ley de Enjuiciamiento Civil,,\n"
    (tmp_path / "s.csv").write_text(body, encoding="utf-8")
    rows = aliases.read_aliases(spark, str(tmp_path / "s.csv"))
    got = {(r["alias"], r["meaning"]): r["meanings"] for r in normalize.alias_dictionary(rows).collect()}
    assert got == {("APDO", "Apartado"): 1, ("LEC", "Ley 1/2000, de 7 de enero"): 2, ("LEC", "Ley de Enjuiciamiento Civil"): 2}
    laws = {r["alias"]: r["law"] for r in normalize.alias_laws(rows).collect()}
    assert laws["L.E.C."] == "Ley 1/2000" and laws["LPAC"] == "Ley 39/2015"


def test_law_index_file(spark, tmp_path):
    (tmp_path / "i.xml").write_text(
        "<response><data><indice><bloque><id>a1</id><titulo> Artículo 1 </titulo></bloque><bloque><id>ti</id></bloque>"
        "<bloque><id>tii</id><titulo>TÍTULO II</titulo><fecha_actualizacion>20240101</fecha_actualizacion></bloque></indice></data></response>", encoding="utf-8")
    got = [(r["id"], r["titulo"]) for r in registry.read_law_index(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == [("a1", "Artículo 1"), ("tii", "TÍTULO II")]


def test_cache_upsert(spark, tmp_path):
    s = "cache_key long, value double, ts timestamp_ntz, event_id long"
    import datetime as dt

    old = spark.createDataFrame([(1, 1.0, dt.datetime(2024, 1, 1), 1), (2, 5.0, dt.datetime(2024, 1, 1), 2)], s)
    new = spark.createDataFrame([(1, 2.0, dt.datetime(2024, 2, 1), 3)], s)
    rows = cache.upsert_latest(old, new)
    assert {r["cache_key"]: r["value"] for r in rows.collect()} == {1: 2.0, 2: 5.0}
    kept = cache.within_ttl(rows, F.lit(dt.datetime(2024, 2, 10)).cast("timestamp_ntz"))
    assert [r["cache_key"] for r in kept.collect()] == [1]
    cache.write_cache(rows.withColumn("html", F.lit("x")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["cache_key", "ts", "event_id", "value"]


def test_a_task_reads_a_short_split_and_smaller_settings_stay(spark, sf_dir):
    from citelake.sources.tables import SPLIT, read_spread, read_table

    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for read in (read_table, read_spread):
            for given, want in (("256MB", str(SPLIT)), ("1m", "1m")):
                for k in keys:
                    spark.conf.set(k, given)
                read(spark, f"{sf_dir}/lineitem.parquet")
                assert [spark.conf.get(k) for k in keys] == [want, want]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
