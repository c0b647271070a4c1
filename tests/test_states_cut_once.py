"""A page's state is cut out once, and backslashes outside of literals do not mislead the cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import embedded

STATE = "DDC.WS.state['ws-inv-data'][\"inventory-data-bus1\"] = "


def test_state_is_cut_once(spark):
    pages = spark.createDataFrame([("r", 1, "https://d.example/", STATE + '{"WIS":{"inventory":[{"title":["a"]}]}};')], "run_id string, page_seq int, url string, html string")
    found = embedded.dealer_dot_com(pages)
    assert found.first().title == "a"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ws-inv-data") == 1 and plan.count("aggregate(") <= 2


def test_object_at_with_backslashes(spark):
    cases = {r'{\"}': None, r'{\"a}\"}x': None, r'{"\"}"}x': r'{"\"}"}', r'{"\\"}}': r'{"\\"}', r'{}\"{': "{}", '{"}': None, r'{\{}}y': r'{\{}}', "{\\": None, 'x{}': None, "": None, '{"😀}\\😀"}z': '{"😀}\\😀"}'}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", embedded.object_at(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases
