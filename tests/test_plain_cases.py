"""Common cases of item expressions are short ways to the same results, and nothing costly is repeated in a plan."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gleanery.functions import identity, urls
from gleanery.operators import normalize as nz

KEY_PARTS = re.compile(urls.PARTS)
URLS = ["", "/", "https://A.example", "https://A.example/", "https://A.example/B/?x=/#y", "https://", "https://#/", "a/b/", "x:", "x:/", "//h/", "https://h/a/\n?q", " https://h/a// ", "?q/", "h#/"]


def _key(url: str) -> str:
    m = KEY_PARTS.match(url.strip())
    path = m.group(5) or ""
    return ((m.group(1) or "") + (m.group(3) or "") + (path if path == "/" else re.sub(r"/(?=\n?\Z)", "", path))).lower()


def test_canonical_key_equals_parts(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "i int, u string").select("i", urls.canonical_key(F.col("u")).alias("k")).collect()
    assert {r.i: r.k for r in rows} == {i: _key(u) for i, u in enumerate(URLS)}


def test_resolve_common_references(spark):
    base, cases = "https://h.example/a/b?x#y", {"/c?q#f": "https://h.example/c?q#f", "/c/../d": "https://h.example/d", "/.": "https://h.example/", "//k/e": "https://k/e", "http://o": "http://o", "ftp:x": "ftp:x", "": "", "e": "https://h.example/a/e", "?z": "https://h.example/a/b?z", "#g": "https://h.example/a/b?x#g"}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", urls.resolve(F.lit(base), F.col("r")).alias("v")).collect()
    assert {r.r: r.v for r in rows} == cases


def test_title_words_count_from_the_year(spark):
    rows = spark.createDataFrame([("Used 2019 Honda Civic LX",), ("2020 Kia Rio x",), ("Old Ford Focus ST",), ("a  (2001) Grand Cherokee L",), ("x2001 b c d",)], "title string").withColumns({"make": F.lit(""), "model": F.lit("")})
    assert [(r.make, r.model) for r in nz.with_title_words(rows).collect()] == [("Honda", "Civic"), ("Kia", "Rio"), ("Ford", "Focus"), ("Grand", "Cherokee"), ("b", "c")]


def test_images_are_lowered_once(spark):
    """Lambdas are evaluated as written: an expression named at each word would be computed at each."""
    images = spark.createDataFrame([(["/A.JPG", "/logo.png", "/A.JPG", "/b-100x200.jpg"],)], "images array<string>")
    found = images.select(identity.vehicle_images(F.col("images")).alias("v"))
    assert found.first().v == ["/A.JPG"]
    out = nz.normalize(images.withColumn("source_url", F.lit("https://h.example/")))
    assert out._jdf.queryExecution().analyzed().toString().count("lower(lambda") == 1
