"""The registry cascade step by step."""

from citelake.operators import registry
from citelake.plans.queries import QUERIES

ENTRIES = [("Ley", 7, 1990, "B-old"), ("Ley", 7, 2010, "B-new"), ("Ley", 7, 2010, "B-other"), ("Real Decreto", 8, 2001, "D-8"), ("Ley", 9, 1950, "B-9")]
REFS = [
    (1, " LEC ", None, None, "BOE-A-2000-323", "name", None),
    (2, "norma", "Ley 39/2015, de 1 de octubre", None, "BOE-A-2015-10565", "title", None),
    (3, "norma", "el Código Civil", None, "BOE-A-1889-4763", "title", None),
    (4, "Ley nº 7/2010", None, 2010, "B-new", "number", None),
    (5, "Ley 7/2005", None, 2005, "B-old", "year", 1990),
    (6, "Ley 7", None, None, "B-new", "year", 2010),
    (7, "Ley 7", None, 1980, None, None, None),
    (8, "Ley 9", None, 1979, "B-9", "year", 1950),
    (9, "Ley 9", None, 1980, None, None, None),
    (10, "Ley Orgánica 3/2099 y la Ley 7/1990", None, 2099, "B-old", "pattern", None),
    (11, "Real Decreto-ley 3/2099 y el RD 8/2001", None, 2099, "D-8", "pattern", None),
    (12, None, None, None, None, None, None),
    (13, "", "", 0, None, None, None),
    (14, "Ley 7/2005", None, 2005, "B-old", "year", 1990),
]


def test_every_step_of_the_cascade(spark):
    refs = spark.createDataFrame([r[:4] for r in REFS], "mention_id int, ref string, title string, ref_year int")
    entries = spark.createDataFrame(ENTRIES, "law_type string, number int, year int, boe_id string")
    rows = registry.registry_cascade(refs, entries, 2024).collect()
    assert sorted((r.mention_id, r.boe_id, r.found_by, r.found_year) for r in rows) == [(r[0], *r[4:]) for r in REFS]
    assert registry.registry_cascade(refs.limit(0), entries, 2024).count() == 0
    known = registry.registry_cascade(refs, entries.limit(0), 2024).where("boe_id is not null").collect()
    assert {r.mention_id for r in known} == {1, 2, 3}


def test_query_uses_all_steps(spark, sf_dir):
    found = QUERIES["registry_cascade"](spark, sf_dir).select("found_by").distinct().collect()
    assert {r.found_by for r in found} == {None, "name", "title", "number", "year", "pattern"}
