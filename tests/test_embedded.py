"""State cut out of scripts, against a plain scanner; link scripts and bounded searches."""

from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.operators import embedded, platforms


def scanned(s):
    """The balanced object that ``s`` begins with, byte by byte."""
    if not s.startswith("{"):
        return None
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(s):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return s[: i + 1]
    return None


@given(st.lists(st.one_of(st.text('{}"\\a\né', max_size=30), st.recursive(st.none() | st.text('{}"\\é\n'), lambda x: st.lists(x) | st.dictionaries(st.text('{}"\\'), x)).map(lambda x: json.dumps({"a": x}) + '}"{')), min_size=1, max_size=60))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_object_at_equals_scanner(spark, texts):
    texts = [x for t in texts for x in (t, "{" + t)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.o for r in df.select("i", embedded.object_at(F.col("t")).alias("o")).collect()} == {i: scanned(t) for i, t in enumerate(texts)}


def test_objects_of_odd_pages(spark):
    deep = json.dumps({"a": ["}{" * 50_000, '\\"' * 50_000, {"b": {}}]})
    mark = "DDC.WS.state['ws-inv-data']['x'] = "
    pages = [None, "", "no state", mark, mark + "[1]", mark + "{", mark + deep + "; }", mark + '{"a": "\\"}"} rest', mark + '{"a": "}', mark + "{} " + mark + '{"b":1}', "{" + mark + "{\\{}}"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r.o for r in df.select("i", embedded.state_object(F.col("html"), embedded.DEALER_DOT_COM_STATE).alias("o")).collect()}
    assert got == {**dict.fromkeys(range(6)), 6: deep, 7: '{"a": "\\"}"}', 8: None, 9: "{}", 10: "{\\{}}"}
    script = embedded.NEXT_DATA.replace("\\", "")
    df = spark.createDataFrame([(script + '{"a":1}</script>x</script>',), (script + "{}",), ("<p>",), (None,)], "html string")
    assert [r[0] for r in df.select(embedded.next_data(F.col("html"))).collect()] == ['{"a":1}', None, None, None]


def test_last_link_of_a_number_wins(spark):
    page = lambda run, host, js: (run, 1, f"https://{host}/cars", f'<i>space.auto</i><script src="{js}"></script>')
    pages = spark.createDataFrame([page("a", "a.test", "https://A.test/space/vehicles.js?1"), page("b", "b.test", "https://a.test/space/vehicles.js?1"), page("c", "c.test", "https://c.test/space/vehicles.js"), ("d", 1, "https://d.test/", None)], "run_id string, page_seq int, url string, html string")
    listed = [{"vin": "v1", "url": "/1"}, {"vin": "V1", "url": "/2"}, {"vin": "v2", "url": ""}, {"vin": None, "url": "/3"}, {"vin": "v4", "url": "/4"}]
    scripts = spark.createDataFrame([("https://A.test/space/vehicles.js?1", f"var space_vehicles_json = {json.dumps(listed)} ;"), ("https://c.test/space/vehicles.js", "var space_vehicles_json = [{] ;"), (None, None)], "url string, body string")
    got = embedded.vehicle_links(pages, scripts)
    assert sorted((r.run_id, r.vin, r.url) for r in got.collect()) == [("a", "V1", "/1"), ("a", "V1", "/2"), ("a", "V4", "/4")]
    sent = json.dumps({"vehicles": [{"vin": "v1", "make": "K"}, {"vin": "v9", "make": "K"}]})
    payloads = spark.createDataFrame([("a", "https://a.test/cars", 1, sent), ("b", "https://b.test/cars", 1, sent)], "run_id string, source_url string, page_seq int, payload string")
    items = platforms.space_auto(payloads, got)
    assert sorted((r.run_id, r.url) for r in items.collect()) == [("a", "/2"), ("a", "/vehicle/v9/"), ("b", "/vehicle/v1/"), ("b", "/vehicle/v9/")]


def test_bounded_responses(spark):
    def kept(total, *sizes, limit=2, most=100):
        rows = [("r", "u", i, json.dumps({"total": total, "vehicles": [{"vin": "x"}] * n})) for i, n in enumerate(sizes)]
        df = spark.createDataFrame([*rows, ("other", "u", 0, "not json")], "run_id string, source_url string, page_seq int, payload string")
        return sorted(r.page_seq for r in embedded.bounded_responses(df, limit, most).collect())

    assert kept(0, 2, 2, 1, 2) == [0, 1, 2] and kept(4, 2, 2, 2) == [0, 1] and kept(9, 2, 0, 2) == [0] and kept(0, 2, 2, 2, most=4) == [0, 1] and kept(0, 0) == []
