"""Card selectors, captures and whole page sets on odd pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.operators import captures, discover, strict

LINK = '<a href="/x">x</a>'
SELECTORS = {
    f"<li>{LINK}</li><li>{LINK}</li>": "li", f"<li>{LINK}</li><li>a</li><li>b</li>": discover.FALLBACK, f"<li>{LINK}</li><li>{LINK}</li><li>b</li><li>c</li><li>d</li>": discover.FALLBACK,
    f"<p data-listing-id=1>{LINK}</p><p data-listing-id=2>{LINK}</p><li>{LINK}</li><li>{LINK}</li>": "[data-listing-id]", f"<div class='a b'>{LINK}</div>" * 3 + f"<section class=c><i>{LINK}</i></section>" * 4: ".c, .a", f"<div class='a'>{LINK}</div>" * 2: discover.FALLBACK,
    f"<div class='outer'><div class='-x 1y é z_1'>{LINK}</div></div>" * 3: ".outer, .z_1", "": discover.FALLBACK, None: discover.FALLBACK, "<div class=a><a>no href</a></div>" * 3: discover.FALLBACK, f"<div itemtype='http://schema.org/Vehicle'>{LINK}</div>" * 2: "[itemtype*='Vehicle']",
}


def test_card_selectors(spark):
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(SELECTORS)], "url string, html string")
    assert {int(r.url): r.selector for r in discover.card_selector(discover.features(df)).collect()} == dict(enumerate(SELECTORS.values()))


def test_platform_defaults(spark):
    schema = "html string, cardSelector string, urlSelector string, titleSelector string, priceSelector string, waitSelectors array<string>, infiniteScroll boolean, scrollMaxAttempts int, clickMaxAttempts int, other int"
    mark = "<i id=DS-inventory-model>"
    df = spark.createDataFrame([(mark, " li ", "a", " ", None, [], False, 0, 7, 1), (mark, ".own", ".u", "h1", ".p", ["w"], None, 3, None, 2), ("plain", "li", "a", "", "", [], False, 0, 0, 3), (None, "li", "a", "", "", None, None, 0, 0, 4)], schema)
    got = {r.other: r for r in discover.with_platform_defaults(df).collect()}
    assert (got[1].cardSelector, got[1].urlSelector, got[1].titleSelector, got[1].priceSelector, got[1].waitSelectors) == (discover.MODEL_CARDS, discover.MODEL_LINKS, discover.MODEL_TITLES, discover.MODEL_PRICES, [discover.MODEL_WAIT])
    assert (got[1].infiniteScroll, got[1].scrollMaxAttempts, got[1].clickMaxAttempts) == (True, 25, 7) and got[2].clickMaxAttempts == 30
    assert (got[2].cardSelector, got[2].urlSelector, got[2].waitSelectors, got[2].scrollMaxAttempts) == (".own", ".u", ["w"], 3)
    assert (got[3].cardSelector, got[3].infiniteScroll, got[3].scrollMaxAttempts) == ("li", False, 0) and got[4].cardSelector == "li"


@pytest.mark.parametrize(("page", "blocked"), [
    ("<a>captcha-delivery.com</a>" + "x" * 300_000, True), ("datadome captcha", False), (captures.BLOCK_ASK, True), ("é" * (3999 - len(captures.BLOCK_ASK)) + captures.BLOCK_ASK, True), ("x" * (4000 - len(captures.BLOCK_ASK)) + captures.BLOCK_ASK, False),
    ('<p id="cf-error-details">' + "x" * 300_000, True), ("Attention Required! | Cloudflare", True), (captures.WAIT_TITLE + captures.WAIT_PATH, True), (captures.WAIT_TITLE, False), (captures.WAIT_TITLE + captures.WAIT_PATH + "x" * 200_000, False), ("", False), (None, False),
])
def test_block_rules(spark, page, blocked):
    assert spark.createDataFrame([(page,)], "h string").select(captures.is_blocked(F.col("h"))).first()[0] is blocked


OK, SHELL, CHALLENGE = ("<p>", 5, None), ("<p>", 0, None), ("<i>captcha-delivery.com", 9, None)
CHOICES = [
    ({"fetch": OK, "first": OK}, ("fetch", None)), ({"fetch": ("<p>", None, None)}, ("fetch", None)), ({"fetch": CHALLENGE, "first": OK}, (None, captures.CHALLENGED)), ({"fetch": SHELL, "rendered": OK}, ("rendered", None)), ({"fetch": SHELL, "rendered": SHELL, "first": OK}, ("first", None)),
    ({"fetch": SHELL}, (None, captures.SHELL)), ({"fetch": (None, None, "HTTP 500")}, (None, "fetch failed: HTTP 500")), ({"fetch": (None, None, "HTTP 500"), "rendered": OK, "plain": OK}, ("plain", None)), ({"first": ("<p>", 1, None)}, ("first", None)), ({"first": ("<p>", 1, None), "second": SHELL}, ("second", None)),
    ({"first": ("<p>", 2, None), "second": OK}, ("first", None)), ({"first": ("<p>", 1, None), "second": (None, None, "crash")}, (None, "crash")), ({"first": (None, None, "a"), "second": (None, None, "b"), "plain": OK}, ("plain", None)), ({"first": (None, None, "a")}, (None, "a")), ({"first": (captures.FIREWALL[1], 4, None)}, (None, "blocked")), ({"plain": (None, None, None)}, (None, "empty")),
]


def test_capture_choice(spark):
    rows = [("r", str(i), w, 1, *c) for i, (given, _) in enumerate(CHOICES) for w, c in given.items()]
    rows += [("r", "late", "fetch", 1, *SHELL), ("r", "late", "fetch", 2, *OK)]
    df = spark.createDataFrame(rows, "run_id string, url string, way string, at int, html string, cards int, error string")
    got = {r.url: (r.way, r.message) for r in captures.choose(df).collect()}
    assert got == {str(i): want for i, (_, want) in enumerate(CHOICES)} | {"late": ("fetch", None)}
    guarded = {r.url: r.message for r in captures.choose(df.where("url = '9'"), protected=True).collect()}
    assert guarded == {"9": captures.UNSERVED}


def listing(x, y, total="", status=" selected"):
    return f"<select name=SoldStatus><option value=All>a</option><option value=AvailableVehicles{status}>b</option></select><div class=pagination>Page {x} of {y}</div><input class=data-inventory-total-records value='{total}'>"


SETS = {
    "whole": ([listing(1, 2, "3"), listing(2, 2, "3")], [2, 1], None), "no total": ([listing(1, 1)], [2], None), "comma": ([listing(1, 1, "1,0")], [10], None), "beyond": ([listing(1, 1, 1), "<p>"], [1, 5], None), "filter": ([listing(1, 1, 1, "")], [1], strict.NO_FILTER),
    "first option": (["<select name=SoldStatus><option value=AvailableVehicles></select>" + listing(1, 1)[listing(1, 1).index("<div") :]], [1], None), "pager": (["<select name=SoldStatus><option value=AvailableVehicles></select>"], [1], strict.NO_PAGER), "zero": ([listing(0, 1)], [1], strict.BAD_PAGER), "past": ([listing(2, 1)], [1], strict.BAD_PAGER),
    "large": ([listing(1, 1001)], [1], strict.BAD_PAGER), "huge": ([listing(1, 10**12)], [1], strict.BAD_PAGER), "total": ([listing(1, 1, "x")], [1], strict.BAD_TOTAL), "total 0": ([listing(1, 1, "0")], [1], strict.BAD_TOTAL), "other page": ([listing(1, 2), listing(1, 2)], [1, 1], "requested page 2 but received page 1; refusing partial sync"),
    "changed": ([listing(1, 2, 2), listing(2, 2, 3)], [1, 1], strict.CHANGED), "empty": ([listing(1, 2), listing(2, 2)], [1, 0], "page 2 has no usable inventory or extraction errors"), "short": ([listing(1, 1, 3)], [2], "collected 2 vehicles, site reports 3; refusing partial sync"), "missing": ([listing(1, 2), None], [1, 1], "page not landed"),
}


def test_complete_sets(spark):
    pages = [(run, i + 1, h) for run, (own, _, _) in SETS.items() for i, h in enumerate(own) if h is not None]
    items = [(run, i + 1, k, f"https://a.test/details/{run}-{i}-{k}") for run, (_, sizes, _) in SETS.items() for i, n in enumerate(sizes) for k in range(n)]
    bad = {"again": "https://a.test/details/1", "http": "http://a.test/details/2", "host": "https://b.test/details/2", "path": "https://a.test/other/2", "none": None}
    pages += [(run, 1, listing(1, 1)) for run in bad]
    items += [(run, 1, k, u) for run, other in bad.items() for k, u in ((1, "https://a.test/details/1"), (2, other))]
    features = strict.set_features(spark.createDataFrame(pages, "run_id string, page_seq int, html string"))
    good, failed = strict.complete_sets(features, spark.createDataFrame(items, "run_id string, page_seq int, pos int, url string"), "a.test", "/details/")
    messages = {r.run_id: r.message for r in failed.collect()}
    assert {k: v for k, v in messages.items() if k in SETS} == {k: v[2] for k, v in SETS.items() if v[2]}
    assert messages["again"] == "repeated vehicle https://a.test/details/1 on page 1; refusing partial sync" and all(messages[k] == f'unexpected detail URL "{bad[k] or ""}"' for k in ("http", "host", "path", "none"))
    want = {"beyond": 1} | {k: sum(v[1]) for k, v in SETS.items() if not v[2] and k != "beyond"}
    assert {r.run_id: r["count"] for r in good.groupBy("run_id").count().collect()} == want
    assert spark.range(1).select(strict.available_page_url(F.lit("https://a.test/inventory"), F.lit(3))).first()[0] == "https://a.test/inventory?SoldStatus=AvailableVehicles&PageNumber=3&PageSize=100"
