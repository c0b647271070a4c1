"""What keeps time, memory and disk in line with the input: pages parsed once and in small slices, narrow tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gleanery.functions import html as tree
from gleanery.functions import urls
from gleanery.operators import page_links, paginate, steps


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_walk_does_not_parse_in_its_turns(spark):
    link = lambda n: f'<div class="card"></div><a class="next" href="?page={n}">n</a>'
    pages = spark.createDataFrame([(f"https://a.example/inventory?page={n}", link(n + 1)) for n in range(1, 5)], "url string, html string")
    starts = spark.createDataFrame([("r", "https://a.example/inventory?page=1")], "run_id string, url string")
    got = page_links.collect(pages, starts, {"cardSelector": ".card"})
    assert [r.page_seq for r in got.pages.orderBy("page_seq").collect()] == [1, 2, 3, 4]
    assert [(r.url[-1], r.message) for r in got.refused.collect()] == [("5", paginate.NOT_LANDED)]
    assert "InPandas" not in plan(got.pages) + plan(got.refused)


def test_texts_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("", 0), (" ", 0), ("7", 7), (" 8 ", 8), ("-3", 0), ("x", 0), (None, 0)], "s string, n int")
    got = rows.select("n", paginate.number(F.col("s")).alias("got"))
    assert [r.n for r in got.collect()] == [r.got for r in got.collect()]
    assert "nullif" in got._jdf.queryExecution().logical().toString()


def test_paging_words(spark):
    given = {"https://a.example/x?PageSize=3": True, "https://a.example/X?P=3": True, "https://a.example/inventory/vehicle-details/3": False, "https://a.example/xp=1": False}
    rows = spark.createDataFrame(list(given.items()), "u string, want boolean")
    assert all(r.want == r.got for r in rows.select("want", urls.is_paging(F.col("u")).alias("got")).collect())


def test_parents_and_ends_of_elements():
    top = tree.parse("<div><p>a<b class='x'>b</b><p>c</div><p class='x y'>d<br><i>e</i>")
    assert [n.tag for n in top.walk()] == ["div", "p", "b", "p", "p", "br", "i"]
    div, last = top.first("div"), top.find("p")[-1]
    assert [n.tag for n in div.walk()] == ["p", "b", "p"] and [n.text() for n in div.find(".x")] == ["b"]
    assert [n.tag for n in top.find("i, .x, div")] == ["div", "b", "p", "i"] and last.find("div, b") == [] and last.first("i").text() == "e"


def test_slices_bound_what_a_worker_holds(spark):
    def sizes(batches):
        for rows in batches:
            yield pd.DataFrame({"n": [len(rows)]})

    got = [r.n for r in steps.map_pages(spark.range(3000).repartition(1), sizes, "n long").collect()]
    assert sum(got) == 3000 and max(got) <= steps.SLICE_ROWS
