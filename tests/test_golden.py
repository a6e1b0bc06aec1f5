"""Golden values of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions import legal, markup, text
from citelake.operators import extract, laws, normalize, registry


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "ref, mended, plain",
    [
        ("Reglamento (UE) 2016/679", "32016R0679", "32016R0679"),
        ("Reglamento (CE) No 593/2008", "32008R0593", "32008R0593"),
        ("Reglamento (UE) No 1215/2012", "32012R1215", "31215R2012"),
        ("Directiva 95/46/CE", "31995L0046", "346L0095"),
        ("Directiva (UE) 2016/680", "32016L0680", "32016L0680"),
        ("Decisión Marco 2002/584/JAI", "32002F0584", None),
        ("Ley 39/2015", None, None),
    ],
)
def test_celex(spark, ref, mended, plain):
    assert one(spark, ref, legal.derive_celex) == mended
    assert one(spark, ref, legal.derive_celex_raw) == plain


@pytest.mark.parametrize("number, word", [(1, "aprimero"), (25, "aveinticinco"), (100, "acien"), (117, "acientodiecisiete"),
                                          (456, "acuatrocientoscincuentayseis"), (20, "aveinte"), (31, "atreintayuno"), (203, "adoscientostres")])
def test_article_words(spark, number, word):
    assert spark.range(1).select(legal.article_word_id(F.lit(number))).first()[0] == word


@pytest.mark.parametrize("raw, number", [("Art. 456", "456"), ("artículo 14", "14"), ("117.3", "117.3"), ("23.2.b", "23.2"), ("único", "único")])
def test_normalize_article(spark, raw, number):
    assert one(spark, raw, legal.normalize_article) == number


@pytest.mark.parametrize("raw, valid", [("23", True), ("23.2", True), ("23.2.b", True), ("24 bis", False)])
def test_article_format(spark, raw, valid):
    assert one(spark, raw, legal.article_format_valid) is valid


@pytest.mark.parametrize("value, eu", [("Artículo 17 del RGPD", True), ("Artículo 138 del CP", False), ("DIRECTIVA UE 1/2", True), ("rgpd", True), ("xRGPDx", False)])
def test_is_eu(spark, value, eu):
    assert one(spark, value, legal.is_eu) is eu


def test_process_names(spark):
    rows = spark.createDataFrame([("RGPD",), ("CP",), ("Ley 39/2015",)], "law string")
    got = {r["law"]: (r["expanded"], r["acronym_known"], r["is_eu"], r["boe_id"], r["celex"]) for r in normalize.process_names(rows).collect()}
    assert got["RGPD"] == ("Reglamento (UE) 2016/679", True, True, None, "32016R0679")
    assert got["CP"] == ("Código Penal", True, False, "BOE-A-1995-25444", None)
    assert got["Ley 39/2015"] == ("Ley 39/2015", False, False, None, None)


def test_registry(spark):
    refs = [("Ley 39/2015", None), ("Ley 40/2015", None), ("LPAC", None), ("LEC", None), ("Ley 999/9999", None),
            ("RD 203/2021", None), ("norma", "Código Penal español"), (" LEY  Orgánica  2/1979", None)]
    got = {r["ref"]: r["boe_id"] for r in registry.registry_ids(spark.createDataFrame(refs, "ref string, title string")).collect()}
    assert got["Ley 39/2015"] == got["LPAC"] == "BOE-A-2015-10565"
    assert got["Ley 40/2015"] == "BOE-A-2015-10566"
    assert got["LEC"] == "BOE-A-2000-323"
    assert got["Ley 999/9999"] is None
    assert got["RD 203/2021"] == "BOE-A-2021-5032"
    assert got["norma"] == "BOE-A-1995-25444"
    assert got[" LEY  Orgánica  2/1979"] == "BOE-A-1979-23709"


def test_validation_reasons(spark):
    rows = [(1, "m1", "Ley 999/9999", "Ley 999/9999", None), (1, "m2", "sin norma", None, None), (1, "m3", "Ley 39/2015", "Ley 39/2015", "4"),
            (1, "m4", "Ley 39/2015", "Ley 39/2015", "03.1.b"), (1, "m5", "Ley 40/2015", "Ley 40/2015", "9")]
    mentions = normalize.normalize_law(spark.createDataFrame(rows, "doc_id long, mention_id string, text string, law string, article string"))
    articles = spark.createDataFrame([("BOE-A-2015-10565", "3")], "boe_id string, number string")
    got = {r["mention_id"]: (r["validated"], r["reason"], r["article_exists"]) for r in registry.validate_mentions(mentions, articles).collect()}
    assert got["m1"] == (False, "No se encontró BOE-ID", None)
    assert got["m2"] == (False, "No se pudo extraer información de ley", None)
    assert got["m3"] == (False, "Artículo 4 NO existe en el BOE oficial", False)
    assert got["m4"] == (True, None, True)
    assert got["m5"] == (True, None, None)  # the law has no index: unknown


def test_law_number_from_title_or_id(spark):
    df = spark.createDataFrame([("a139", "Artículo 139. Asesinato"), ("a7", "Asesinato"), ("xx", "nada")], "id string, t string")
    assert [r[0] for r in df.select(laws.article_number(F.col("t"), F.col("id"))).collect()] == ["139", "7", None]


DEMO = (
    "Según la Ley 39/2015 y el Real Decreto 203/2021, la LPAC se aplica. El art. 23.2.b de la LPAC y el artículo 24 CE"
    " remiten a la LEC y a la LJCA. La Ley 39/2015 rige."
)


def test_demo_text(spark):
    docs = spark.createDataFrame([(1, DEMO)], "doc_id long, text string")
    rows = extract.extract(docs).collect()
    by_agent = lambda a: {(r["kind"], r["law"], r["article"]) for r in rows if r["agent"] == a}
    assert by_agent("A") == {("ley", "39/2015", None), ("ley", "203/2021", None)}
    assert {("sigla", s, None) for s in ("LPAC", "CE", "LEC", "LJCA")} <= by_agent("B")
    assert {("articulo", None, "23.2.b"), ("articulo", None, "24")} <= by_agent("B")
    for r in rows:  # offsets point at the mention in the prepared text
        assert DEMO.replace(" ", " ")[r["start"]:].startswith(r["text"])
    full = {(r["article"], r["law"]) for r in extract.extract_article_law(docs).collect()}
    assert full == {("23.2.b", "LPAC"), ("24", "CE")}


def test_offsets_of_many_matches(spark):
    """More matches than one prefix-sum block holds."""
    body = " ".join(f"Ley {i}/2015 {'x' * (i % 7)}" for i in range(1500))
    rows = extract.extract(spark.createDataFrame([(1, body)], "doc_id long, text string"), ("A",)).collect()
    assert len(rows) == 1500
    assert all(body[r["start"]:].startswith(r["text"]) for r in rows)


def test_loose_position(spark):
    df = spark.createDataFrame([("ver art 5\n CE", "art. 5 CE"), ("nada", "art. 5 CE"), ("x (a+b)", "(a+b)")], "t string, m string")
    got = [r[0] for r in df.select(extract.position_in(F.col("t"), F.lower("t"), F.col("m"))).collect()]
    assert got == [5, 0, 3]


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 199, 200, 201, 1800, 1801, 3800, 3801, 9999):
        body = "".join(chr(97 + i % 26) for i in range(n))
        df = spark.createDataFrame([(body,)], "t string").select(F.inline(text.chunk_text(F.col("t"), 2000, 200)))
        parts = sorted((r["start"], r["chunk"]) for r in df.collect())
        joined = ""
        for start, chunk in parts:
            assert start <= len(joined)
            joined = joined[:start] + chunk
        assert joined == body


def test_unclosed_markup(spark):
    html = '<body><h1>T &amp; U</h1><p><b>uno <i>dos</i> tres<br><p>cuatro<ul><li>a<li>b</ul><!-- <p>no</p> --><script>"<p>no</p>"</script><h3>fin</h3></body>'
    got = one(spark, html, markup.clean_text)
    assert got == "T & U\nunodostres\ncuatro\n- a\n- b\n\nfin"


def test_last_article_variant(spark):
    html = "<p>Artículo 1. Uno.</p><p>texto</p><p>Artículo 2. Dos.</p><p>Artículo 1. Otra.</p><p>más</p>"
    df = spark.createDataFrame([(html,)], "h string")
    first = df.select(F.inline(markup.articles(F.col("h")))).collect()
    last = df.select(F.inline(markup.articles(F.col("h"), keep="last"))).collect()
    assert [(r["number"], r["title"], r["body"]) for r in first] == [("1", "Uno", "Artículo 1. Uno. texto"), ("2", "Dos", "Artículo 2. Dos.")]
    assert [(r["number"], r["body"]) for r in last] == [("2", "Artículo 2. Dos."), ("1", "Artículo 1. Otra. más")]


def test_dictionaries_are_small():
    for d in (dims.LAW_ACRONYMS, dims.EU_ACRONYMS, dims.EU_CELEX, dims.registry_entries(), dims.law_titles()):
        assert len(d) < 200
    assert set(dims.EU_CELEX) == set(dims.EU_ACRONYMS)
