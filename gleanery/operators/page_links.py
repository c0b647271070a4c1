"""The links of landed listing pages to their further pages, in the order in which a crawler follows them.

The tree of a page is parsed once, in Arrow batches, to its features: hrefs by selector, pager texts and counts. All rules on
URLs are expressions over those.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text, urls
from . import embedded, paginate
from .steps import map_pages, written

# Where pages link their further pages and state their counts, in order.
NEXT_LINKS = (
    "link[rel='next']", "a[rel='next']", "a[aria-label='Next']", "a[aria-label='next']", "nav[class*='pagination'] a[href]", "ul[class*='pagination'] a[href]", "ul[class*='page'] a[href]",
    "[class*='pagination'] a[href]", "a[class*='next'][href]", "a[href*='/page/']", "a[href*='page=']",
)
PAGER, ANY_PAGER = "[class*='pagination']", "[class*='pagination'], [class*='pager']"
ANY_PAGER_LINKS = "[class*='pagination'] a[href], [class*='pager'] a[href]"
ROLE_PAGER, SUMMARY_PAGER = "[data-role='pager']", "[class*='pager-summary'], .i08r_pager"
COUNT_LABEL, COUNT_INPUT, COUNT_ATTRIBUTE, MODEL = ".pagination_settings__page_count", "input.pagination_settings__input", "dealr-pagination", "#ds-inventory-model"
TOTAL_INPUT = "input.data-inventory-total-records"
NUMBERED = r"(?i)[?&](page|p)=([0-9]+)"
MOST_COUNTED = 500

FEATURES = "url string, html string, cards int, hrefs array<string>, pager string, pager_links int, role_pager string, role_links int, summary string, count_label string, count_input string, count_attribute string, stated_total int, stated_count int, widget array<string>, any_pager string, total_text string, body string, total_input string"


def number(s: str) -> int:
    """A non-negative decimal number, else 0."""
    s = s.strip()
    digits = s[1:] if s[:1] in ("+", "-") else s
    return max(int(s), 0) if digits.isascii() and digits.isdigit() and int(s) < 1 << 31 else 0


def _numbered(top: html.Node, selector: str) -> int:
    return sum(number(n.text()) > 0 for n in top.find(selector))


#: Bodies of up to so many characters are remembered by a worker with what was found in them, so many of them.
MEMO_CHARS, MEMO_BODIES = 16_384, 256


@lru_cache(maxsize=64)
def _selectors(site: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """The card selector, those of total hints and those of next links, of a template in JSON."""
    given = json.loads(site)
    hints = tuple(s for s in (given.get("totalSelector", ""), *given.get("totalHints", ())) if s)
    first = given.get("pagination", {}).get("nextSelector")
    return given.get("cardSelector", ""), hints, (*([first] if first else []), *NEXT_LINKS)


def _found(page: str | None, site: str) -> tuple:
    """What a page holds, in the order of ``FEATURES`` behind ``html``: it follows from the body alone."""
    cards, hints, selectors = _selectors(site)
    top = html.parse(page)
    role, model = top.first(ROLE_PAGER), top.first(MODEL)
    attribute, summary = top.first(f"[{COUNT_ATTRIBUTE}]"), top.first(SUMMARY_PAGER)
    texts = [t for s in hints if (t := top.first_text(s))]
    return (
        len(top.find(cards)) if cards else None, [n.attrs["href"] for s in selectors for n in top.find(s) if n.attr("href")],
        "".join(n.text() for n in top.find(PAGER)), _numbered(top, f"{PAGER} a[href]"), role.text() if role else None, sum(_numbered(n, "a[href]") for n in top.find(ROLE_PAGER)), summary.text() if summary else "",
        top.first_text(COUNT_LABEL), top.first_attr(COUNT_INPUT, "value"), attribute.attr(COUNT_ATTRIBUTE) if attribute else "", number(model.attr("data-results-total")) if model else 0, number(model.attr("data-results-count")) if model else 0,
        [n.attrs["href"] for n in top.find(ANY_PAGER_LINKS)], "".join(n.text() for n in top.find(ANY_PAGER)), "\n".join(texts), top.text(), top.first_attr(TOTAL_INPUT, "value"),
    )


@lru_cache(maxsize=MEMO_BODIES)
def _remembered(page: str | None, site: str) -> tuple:
    return _found(page, site)


def _features(site: dict):
    template = json.dumps(site)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for rows in batches:
            made = [(u, h, *(_remembered if len(h or "") <= MEMO_CHARS else _found)(h, template)) for u, h in zip(rows["url"], rows["html"], strict=True)]
            columns = zip(names, zip(*made, strict=True), strict=True)
            yield pd.DataFrame({n: pd.array(c, dtype="Int32") if n == "cards" else list(c) for n, c in columns})

    return run


def features(pages: DataFrame, site: dict) -> DataFrame:
    """``url, html`` and the features of each page (url, html) under a template's selectors."""
    return map_pages(pages.select("url", "html").where("url is not null").dropDuplicates(["url"]), _features(site), FEATURES)


def served_page(c: Column) -> Column:
    """The page that the pagers' text names ("Page 2 of 7"), else 0."""
    return paginate.group_number(c, paginate.PAGE_OF, 1)


def total_items(f: DataFrame) -> Column:
    """The stated size of the inventory: the template's selectors, the page's text, then counts in attributes."""
    first = F.lit(0)
    lines = F.transform(F.split("total_text", "\n"), paginate.total)
    first = F.coalesce(F.get(F.filter(lines, lambda n: n > 0), F.lit(0)), first)
    return F.coalesce(*[F.when(c > 0, c) for c in (first, paginate.total(F.col("body")), F.col("stated_total"), paginate.number(F.col("total_input")))], F.lit(0))


def _between(url: Column, name: str, now: Column, last: Column, rule: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.when((now > 0) & (now < last) & (rule if rule is not None else F.lit(True)), paginate.pages_between(url, name, now + 1, last)).otherwise(none)


def _elided(url: Column) -> Column:
    """Page numbers that a widget leaves out, built on its own first link."""
    resolved = F.transform("widget", lambda h: F.struct(F.regexp_extract(h, NUMBERED, 1).alias("name"), paginate.number(F.regexp_extract(h, NUMBERED, 2)).alias("n"), urls.resolve(url, text.trim(h)).alias("to")))
    named = F.filter(resolved, lambda r: r["name"] != "")
    name = F.lower(F.get(named, F.lit(0))["name"])
    own = F.filter(named, lambda r: urls.same_host(url, r["to"]))
    template = F.get(own, F.lit(0))["to"]
    linked = F.transform(F.filter(own, lambda r: r["n"] > 0), lambda r: r["n"])
    none = F.array().cast("array<string>")
    by = lambda p: F.when(urls.query_int(url, p) > 1, none).otherwise(F.coalesce(paginate.elided_urls(template, p, linked), none))
    return F.when(name == "p", by("p")).when(name == "page", by("page")).otherwise(none)


def page_links(f: DataFrame) -> DataFrame:
    """``url, place, next_url`` from ``features``: each page's links in order, each once."""
    return _each_link(_link_lists(f))


def _each_link(lists: DataFrame) -> DataFrame:
    return lists.select("url", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("last"))).alias("place", "next_url"))


def _link_lists(f: DataFrame, *others: Column | str) -> DataFrame:
    """``url, found, last`` and other columns of ``features``: a page's links, and those that count if there are none."""
    url, none = F.col("url"), F.array().cast("array<string>")
    absolute = F.transform("hrefs", lambda h: urls.resolve(url, text.trim(h)))
    linked = F.filter(absolute, lambda u: (u != "") & urls.same_host(url, u) & urls.is_paging(u) & ~urls.is_bare_self_link(url, u))
    stated = F.when(F.col("pager_links") < 2, paginate.page_of_urls(url, F.col("pager"))).otherwise(none)
    summary = _between(url, "page", paginate.group_number(F.col("summary"), paginate.PAGE_OF, 1), paginate.group_number(F.col("summary"), paginate.PAGE_OF, 2))
    counted, own = paginate.number(F.col("count_label")), urls.query_int(url, "p")
    label = _between(url, "p", F.greatest(F.coalesce(F.nullif(own, F.lit(0)), paginate.number(F.col("count_input"))), F.lit(1)), counted)
    attribute = paginate.counted_urls(url, paginate.number(F.col("count_attribute")))
    showing = F.when(F.col("role_pager").isNotNull() & (F.col("role_links") < 2), paginate.showing_urls(url, F.col("role_pager"))).otherwise(none)
    data = F.from_json(embedded.next_data(F.col("html")), "props struct<pageProps:struct<page:int,pageCount:int,inventory:struct<meta:struct<total:int>,results:array<string>>>>")["props"]["pageProps"]
    held = F.size(data["inventory"]["results"])
    grand = data["inventory"]["meta"]["total"]
    pages = F.when(data["pageCount"] > 0, data["pageCount"]).when((held > 0) & (grand > held), F.ceil(grand / held).cast("int")).otherwise(0)
    stated_now = F.when(data["page"] > 0, data["page"]).otherwise(1)
    data_now = F.coalesce(F.nullif(urls.query_int(url, "page"), F.lit(0)), stated_now)
    next_pages = _between(url, "page", data_now, pages, (stated_now < pages) & (pages <= MOST_COUNTED))
    state = F.from_json(embedded.state_object(F.col("html"), embedded.DEALER_DOT_COM_STATE), "WIS struct<pageInfo:struct<totalCount:int,pageSize:int>,inventory:array<struct<vin:string>>>")["WIS"]
    offsets = F.when(F.size(state["inventory"]) > 0, paginate.offset_urls(url, state["pageInfo"]["totalCount"], state["pageInfo"]["pageSize"])).otherwise(none)
    following = F.array_compact(F.array(paginate.zero_based_url(url, F.col("stated_total"), F.col("stated_count"))))
    every = [linked, following, stated, summary, label, attribute, showing, _elided(url), next_pages, offsets]
    found = F.array_distinct(F.concat(*[F.coalesce(e, none) for e in every]))
    last = paginate.remaining_zero_based(url, F.col("stated_total"), F.col("stated_count"))
    return f.select("url", *others, found.alias("found"), last.alias("last"))


def collect(pages: DataFrame, starts: DataFrame, site: dict) -> paginate.Walk:
    """All pages of each run, from landed pages (url, html) and each run's first (run_id, url), and those refused."""
    most = site.get("pagination", {}).get("maxPages", 0) or paginate.MAX_PAGES
    served = served_page(F.col("any_pager")).alias("served")
    read = written(_link_lists(features(pages, site), "cards", served, "stated_total", "stated_count"), "paging-pages")  # parsed once, not every turn
    return paginate.walk(paginate.judged(read), _each_link(read), paginate.bounds(starts, read.select("url", "stated_total", "stated_count"), most))


# A platform whose landing page leads to two sections, and what its pages hold.
SECTION_MARKS, SECTION_CARD, SECTION_LINK, SECTIONS, LANDING = ("secureoffersites.com", "inventory-car-parent-box"), "[class*='inventory-car-parent-box']", "a[href*='/viewdetails/']", ("new", "used"), "/inventory"


def is_landing(url: Column, page: Column, notes: str = "") -> Column:
    """Whether a page is the landing page of such a site, by its marks or by the template's notes."""
    marked = F.lit("team velocity" in notes.lower()) | embedded.holds(page, SECTION_MARKS)
    return marked & (urls.authority(url) != "") & (F.lower(F.regexp_replace(urls.path(url), "/$", "")) == LANDING)


def _section_cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [(u, i, card.first_attr(SECTION_LINK, "href")) for u, h in zip(rows["url"], rows["html"], strict=True) for i, card in enumerate(html.parse(h).find(SECTION_CARD))]
        yield pd.DataFrame(found, columns=["url", "pos", "key"])


def section_union(landing: DataFrame, pages: DataFrame, notes: str = "", sections: tuple[str, ...] = SECTIONS, most: int = paginate.MOST_SECTION_PAGES) -> DataFrame:
    """``run_id, url, section, page, pos, key``: the cards of the sections behind landing pages (run_id, url, html), read from
    landed pages (url, html) until a page adds none."""
    runs = landing.where(is_landing(F.col("url"), F.col("html"), notes)).select("run_id", F.concat(urls.part(F.col("url"), 1), urls.part(F.col("url"), 3), F.lit(f"{LANDING}/")).alias("base")).distinct()
    every = runs.select("run_id", "base", F.explode(F.array(*map(F.lit, sections))).alias("section")).select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("page"))
    asked = every.select("run_id", "section", "page", F.concat("base", "section", F.when(F.col("page") > 1, F.concat(F.lit("?page="), "page")).otherwise("")).alias("url"))
    cards = pages.select("url", "html").dropDuplicates(["url"]).join(asked.select("url").distinct(), "url", "left_semi")
    cards = map_pages(cards, _section_cards, "url string, pos int, key string")
    return paginate.first_added(cards.join(asked, "url"), ["run_id"], list(sections), most).select("run_id", "url", "section", "page", "pos", "key")
