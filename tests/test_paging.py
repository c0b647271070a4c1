"""The paging walk against a queue in Python, the links of pages, and the union of sections that ends where nothing is added."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import page_links, paginate


def queue_walk(start, links, verdicts, most):
    """Pages and refusals in the order of a crawler: ``links`` by URL, ``verdicts`` None for a good page."""
    pages, seen, refused, at = [start], {start}, [], 0
    while at < len(pages) and len(pages) < most:
        for place, url in enumerate(links.get(pages[at], [])):
            if len(pages) >= most:
                break
            if url in seen:
                continue
            message = verdicts.get(url, paginate.NOT_LANDED)
            if message:
                refused.append((url, message, at + 1, place))
            else:
                seen.add(url)
                pages.append(url)
        at += 1
    return pages, refused


def test_walk_equals_a_queue(spark):
    rng, landed, links, starts, want = random.Random(5), [], [], [], {}
    for run in range(80):
        size, most = rng.randint(1, 25), rng.choice([1, 2, 3, 5, 8, 20, 50])
        names = [f"r{run}-{i}" for i in range(size)]
        verdicts = {n: rng.choice([None, None, None, "bad", "worse"]) for n in names if rng.random() < 0.9}
        own = {n: rng.sample(names, rng.randint(0, min(5, size))) for n in names}
        landed += verdicts.items()
        links += [(n, i, t) for n, to in own.items() for i, t in enumerate(to)]
        starts.append((f"run{run}", names[0], most))
        want[f"run{run}"] = queue_walk(names[0], own, verdicts, most)
    shuffled = lambda rows: rng.sample(rows, len(rows))
    got = paginate.walk(spark.createDataFrame(shuffled(landed), "url string, message string"), spark.createDataFrame(shuffled(links), "url string, place int, next_url string"), spark.createDataFrame(starts, "run_id string, url string, max_pages int"))
    pages, refused = {r: [] for r in want}, {r: [] for r in want}
    for r in got.pages.orderBy("run_id", "page_seq").collect():
        pages[r.run_id].append(r.url)
    for r in got.refused.orderBy("run_id", "parent_seq", "place").collect():
        refused[r.run_id].append((r.url, r.message, r.parent_seq, r.place))
    assert {r: (pages[r], refused[r]) for r in want} == want
    assert sum(len(x[1]) for x in want.values()) > 50


def test_walk_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    links, landed = none("url string, place int, next_url string"), none("url string, message string")
    assert paginate.walk(landed, links, none("run_id string, url string")).pages.count() == 0
    got = paginate.walk(landed, links, spark.createDataFrame([("r", "u")], "run_id string, url string"))
    assert [tuple(r) for r in got.pages.collect()] == [("r", 1, "u")] and got.refused.count() == 0


def test_parameters_are_written_by_name(spark):
    cases = {
        "https://a.test/l?z=1&b=2&b=1": "https://a.test/l?b=2&b=1&page=3&z=1", "https://a.test/l": "https://a.test/l?page=3", "https://a.test/l?page=1&page=2&a=x%20y+z~*": "https://a.test/l?a=x+y+z~%2A&page=3", "https://a.test/l?a;b=1&c=%zz&d#top": "https://a.test/l?d=&page=3#top",
        "/l?q=%C3%A9&": "/l?page=3&q=%C3%A9",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", paginate.with_parameter(F.col("u"), "page", F.lit(3)).alias("v"))
    assert {r.u: r.v for r in df.collect()} == cases


U = "https://a.test/inventory"
STATE = "DDC.WS.state['ws-inv-data']['x'] = "
PAGES = {
    "selectors in order, each link once": (U, "<a class='my-next' href='?page=5'>n</a><ul class=pagination><li><a href='/inventory?page=2'>2</a><li><a href='?page=3#x'>3</a></ul><link rel=next href='?page=2'><a href='https://b.test/?page=9'>x</a><a href='/blog/page/'>b</a>", ["?page=2", "?page=3#x", "?page=5", "/blog/page/"]),
    "a bare link to itself is no page": (U, "<a rel=next href='/inventory/'>n</a><a rel=next href='#'>n</a><a rel=next href='/about'>a</a>", []),
    "page of, by PageNumber": (U + "?b=1", "<div class='x-pagination'>PrevPage: 1 of 3Next</div>", ["?PageNumber=2&PageSize=100&b=1", "?PageNumber=3&PageSize=100&b=1"]),
    "page of, but linked": (U, "<div class=pagination>Page 1 of 9 <a href='/x?page_no=2'>2</a><a href='/x?page_no=3'>3</a></div>", []),
    "summary, by page": (U, "<div class=pager-summary>Page: 1 of 3</div>", ["?page=2", "?page=3"]),
    "summary on the last page": (U, "<div class=i08r_pager>Page: 3 of 3</div>", []),
    "count label, by p, from the URL": (U + "?p=2", "<b class=pagination_settings__page_count>4</b><input class=pagination_settings__input value=9>", ["?p=3", "?p=4"]),
    "count label, from the input": (U, "<b class=pagination_settings__page_count> 3 </b><input class=pagination_settings__input value=2>", ["?p=3"]),
    "count attribute": (U, "<ul dealr-pagination=3></ul>", ["?page=2", "?page=3"]),
    "role pager": (U, "<div data-role=pager>Showing 25 - 48 of 60 Results</div>", ["?Paging.Page=3"]),
    "role pager with links": (U, "<div data-role=pager>Showing 1 - 24 of 60<a href='#a'>2</a><a href='#b'>3</a></div>", []),
    "elided numbers, by the widget's own name and form": (U, "<div class=pager><a href='/inventory/new?x=1&p=2'>2</a><a href='/inventory/new?x=1&p=5'>5</a></div>", ["/inventory/new?p=3&x=1", "/inventory/new?p=4&x=1"]),
    "elided numbers from a later page": (U + "?p=2", "<div class=pager><a href='?p=9'>9</a></div>", []),
    "result counts, the next": (U + "?ai_page=1", "<i id=ds-inventory-model data-results-total=95 data-results-count=20></i>", ["?ai_page=2"]),
    "result counts, the last": (U + "?ai_page=4", "<i id=ds-inventory-model data-results-total=95 data-results-count=20></i>", []),
    "data script with a page count": (U, '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"page":1,"pageCount":3}}}</script>', ["?page=2", "?page=3"]),
    "data script with a total": (U + "?page=2", '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"inventory":{"meta":{"total":7},"results":[{"a":1},{}]}}}}</script>', ["?page=3", "?page=4"]),
    "data script with too many": (U, '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"pageCount":501}}}</script>', []),
    "state in a script": (U, f'<script>{STATE}{{"WIS":{{"pageInfo":{{"totalCount":50,"pageSize":20}},"inventory":[{{"vin":"}}"}}]}}}}</script>', ["?start=20", "?start=40"]),
    "nothing": (U, "", []),
}


def test_page_links(spark):
    pages = spark.createDataFrame([(u.replace("a.test", f"a{i}.test"), h) for i, (u, h, _) in enumerate(PAGES.values())], "url string, html string")
    got = {}
    for r in page_links.page_links(page_links.features(pages, {})).orderBy("place").collect():
        got.setdefault(r.url.split("/")[2], []).append(r.next_url)
    for i, (name, (_, _, links)) in enumerate(PAGES.items()):
        host = f"a{i}.test"
        want = [x if "://" in x else f"https://{host}{x}" if x.startswith("/") else f"https://{host}/inventory{x}" for x in links]
        assert got.get(host, []) == want, name


def test_collect_walks_landed_pages(spark):
    pager = lambda now, *to: f"<i class=card></i><div class=pager>Page {now} of 9</div>" + "".join(f"<a class=next href='?page={t}'>n</a>" for t in to)
    html = {U: pager(1, 2, 3, 4, 5), U + "?page=2": pager(2, 6), U + "?page=3": pager(1), U + "?page=4": "<b>none</b>", U + "?page=6": pager(6, 3, 7)}
    pages = spark.createDataFrame([*html.items(), (U, html[U])], "url string, html string")
    got = page_links.collect(pages, spark.createDataFrame([("r", U)], "run_id string, url string"), {"cardSelector": ".card"})
    assert [r.url[len(U) :] for r in got.pages.orderBy("page_seq").collect()] == ["", "?page=2", "?page=6"]
    refused = [(r.url[len(U) :], r.message) for r in got.refused.orderBy("parent_seq", "place").collect()]
    assert refused == [("?page=3", "requested page 3 but got page 1"), ("?page=4", paginate.NO_CARDS), ("?page=5", paginate.NOT_LANDED), ("?page=3", "requested page 3 but got page 1"), ("?page=7", paginate.NOT_LANDED)]


def test_bounds_by_stated_counts(spark):
    starts = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3"), ("d", "u4")], "run_id string, url string")
    counts = spark.createDataFrame([("u1", 950, 20), ("u2", 9500, 20), ("u3", 100, 20)], "url string, stated_total int, stated_count int")
    assert {r.run_id: r.max_pages for r in paginate.bounds(starts, counts).collect()} == {"a": 48, "b": 200, "c": 20, "d": 20}


def test_totals(spark):
    pages = ["<b id=t>1 - 20 of 148 vehicles</b>", "<p>Page 1 of 9</p><i id=ds-inventory-model data-results-total=77></i>", "<input class=data-inventory-total-records value=33>", "<b id=t>none</b><b id=h>total 1,200</b>", "12 cars available"]
    f = page_links.features(spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "url string, html string"), {"totalSelector": "#t", "totalHints": ["#h"]})
    assert [r.n for r in f.select("url", page_links.total_items(f).alias("n")).orderBy("url").collect()] == [148, 77, 33, 1200, 12]


def read_sections(cards, sections, most):
    """Reads sections page by page, as long as a page adds a new key."""
    seen, out = set(), []
    for section in sections:
        for page in range(1, most + 1):
            added = 0
            for pos, key in sorted(cards.get((section, page), [])):
                key = (key or "").strip().lower()
                if key and key not in seen:
                    seen.add(key)
                    out.append((section, page, pos))
                    added += 1
            if not added:
                break
    return out


def test_sections_end_where_nothing_is_added(spark):
    rng, rows, want = random.Random(3), [], {}
    for run in range(120):
        cards = {}
        for section in ("new", "used", "other"):
            for page in range(1, rng.randint(1, 7)):
                if rng.random() < 0.9:
                    cards[section, page] = [(pos, rng.choice([None, "", " k1 ", *(f"K{rng.randint(0, 12)}" for _ in range(6))])) for pos in range(rng.randint(0, 4))]
        rows += [(run, s, p, pos, key) for (s, p), own in cards.items() for pos, key in own]
        want[run] = read_sections(cards, ("used", "new"), 4)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "run int, section string, page int, pos int, key string")
    got = {r: [] for r in want}
    for r in paginate.first_added(df, ["run"], ["used", "new"], 4).collect():
        got[r.run].append((r.section, r.page, r.pos))
    order = lambda x: ({"used": 0, "new": 1}[x[0]], *x[1:])
    assert {r: sorted(v, key=order) for r, v in got.items()} == want


def test_section_union_from_pages(spark):
    card = lambda *keys: "".join(f"<div class='x inventory-car-parent-box'><a href='/about'>a</a><a href='{k}'>c</a></div>" for k in keys)
    base = "https://a.test/inventory/"
    pages = {base + "new": card("/viewdetails/1", "/viewdetails/2"), base + "new?page=2": card("/VIEWDETAILS/2", "/viewdetails/3"), base + "new?page=3": card("/viewdetails/1"), base + "new?page=4": card("/viewdetails/9"), base + "used": card("/viewdetails/3", "/viewdetails/4", "/other")}
    landing = spark.createDataFrame([("r", "https://a.test/Inventory/", card("/viewdetails/7")), ("s", "https://a.test/inventory/new", card()), ("t", "https://b.test/inventory", "plain")], "run_id string, url string, html string")
    got = page_links.section_union(landing, spark.createDataFrame(list(pages.items()), "url string, html string"))
    assert sorted((r.run_id, r.section, r.page, r.key) for r in got.collect()) == [("r", "new", 1, "/viewdetails/1"), ("r", "new", 1, "/viewdetails/2"), ("r", "new", 2, "/viewdetails/3"), ("r", "used", 1, "/viewdetails/4")]


@pytest.mark.parametrize("text,value", [(" 12 ", 12), ("+3", 3), ("-3", 0), ("1,2", 0), ("", 0), ("٣", 0), ("99999999999", 0)])
def test_numbers(text, value):
    assert page_links.number(text) == value
