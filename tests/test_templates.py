"""Templates as a table of YAML files, and refinements of listing URLs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators import refine
from gleanery.sources import readers

PAGES = {
    "https://a.test/used": "name: own\nlistPage:\n  cardSelector: .c\n  pagination:\n    maxPages: 3\n    clickMaxAttempts: 5\n", "https://b.test/used": "carsCommerce:\n  ccid: '1'\n", "https://c.test/used": "listPage: {cardSelector: ''}", "https://d.test/used": "listPage: [", "https://e.test/used": "- a", "https://f.test/used": "", "https://g.test/used": "listPage: 3",
}


def test_template_files(spark, tmp_path):
    pytest.importorskip("yaml")
    keys = spark.createDataFrame([(u,) for u in PAGES], "u string").select("u", urls.template_key(F.col("u")).alias("k"), urls.template_file(urls.template_key(F.col("u"))).alias("f")).collect()
    for r in keys:
        (tmp_path / f"{r.f}.yaml").write_text(PAGES[r.u])
    (tmp_path / f"{keys[0].f}.yml").write_text("listPage: {cardSelector: .other}")
    (tmp_path / "README.txt").write_text("no template")
    got = {r.key: r for r in readers.template_files(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == {r.k for r in keys if PAGES[r.u]}
    a, b, c, d, e, g = (got[r.k] for r in keys if PAGES[r.u])
    assert a.name == "own" and json.loads(a.template)["listPage"]["pagination"] == {"maxPages": 3, "clickMaxAttempts": 5, "scrollMaxAttempts": 8} and json.loads(a.template)["listPage"]["cardSelector"] == ".c"
    assert b.name == keys[1].k and json.loads(b.template)["listPage"]["pagination"]["clickMaxAttempts"] == 20 and b.error is None
    assert c.error == readers.NO_CARDS and d.error.startswith("invalid YAML") and e.error and g.error and {c.template, d.template, e.template, g.template} == {None}


B, T = "https://a.test/used", ["Used", "New"]
CASES = [
    ((B, B, T, ""), ("low_price", T, None)), ((B + "/?_dFR[type][0]=New", B + "/", T, ""), ("low_price", ["New"], None)), ((B + "?_dFR%5Btype%5D%5B10%5D=Used&_dFR[type][2]=New&_dFR[type][3]=Used", B, T, ""), ("low_price", ["Used", "New"], None)), ((B + "?idx=year_high_to_low&utm_a=1&utm_a=2&fbclid=", B, None, "Used"), ("year", ["Used"], None)),
    ((B, B, [], ""), (None, None, refine.NO_TYPES)), ((B, B, ["Used", ""], ""), (None, None, refine.NO_TYPES)), ((B, B, None, None), (None, None, refine.NO_TYPES)), (("https://b.test/used", B, T, ""), (None, None, refine.OTHER_PAGE)), (("https://A.test/other", B, T, ""), (None, None, refine.OTHER_PAGE)), ((None, B, T, ""), (None, None, refine.OTHER_PAGE)),
    ((B + "?x=1&idx=q", B, T, ""), (None, None, 'unsupported inventory sort "q"')), ((B + "?z=1&a%22=1", B, T, ""), (None, None, 'unsupported inventory query parameter "a\\""')), ((B + "?idx=a&idx=b", B, T, ""), (None, None, 'unsupported repeated inventory parameter "idx"')), ((B + "?_dFR[type][0]=Old", B, T, ""), (None, None, 'inventory type does not match configured ["Used" "New"] page')),
    ((B + "?_dFR[type][a]=New", B, T, ""), (None, None, 'unsupported inventory query parameter "_dFR[type][a]"')), ((B + "?a=%zz", B, T, ""), (None, None, 'invalid URL escape "%zz"')), ((B + "?utm_x=1;2", B, T, ""), (None, None, "invalid semicolon separator in query")), ((B + "?&&", B, T, ""), ("low_price", T, None)),
]


def test_refinements(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(CASES)], "i int, url string, base_url string, vehicle_types array<string>, vehicle_type string")
    assert [(r.sort, r.types, r.error) for r in refine.refinements(df).orderBy("i").collect()] == [want for _, want in CASES]
