"""Page diagnostics read whole pages, however far down the title and the marker are."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F

from gleanery.operators import diagnostics
from gleanery.plans import oracles


def test_title_and_marker_behind_the_first_256_kib(spark):
    html = "<html><!--" + "é" * 200_000 + "--><title> Far  down </title><p>Access DENIED</p>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = diagnostics.page_diagnostics(pages).first()
    assert (got.title, got.block_marker) == ("Far  down", "access denied")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [html])
    want = con.execute(oracles.ORACLE_SQL["page_diagnostics"]).fetchone()
    assert (got.page_id, got.bytes, got.body_sha256, got.title, got.block_marker) == want


def test_titles_without_an_end_cost_no_square(spark):
    pages = spark.createDataFrame([(1, "<title" * 200_000), (2, "<title>" * 200_000), (3, "<title>a<title>b</title><title>c</title>")], "page_id long, html string")
    started = time.monotonic()
    got = [r.title for r in pages.select("page_id", diagnostics.title(F.col("html")).alias("title")).orderBy("page_id").collect()]
    assert got == ["", "", "a<title>b"] and time.monotonic() - started < 60
