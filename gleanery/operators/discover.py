"""What repeats on a page: the selector of its cards, from well-known selectors or from the classes of linked containers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from .steps import map_pages

# Selectors in order of trust, containers, what else cards are, how often a class must come, and a platform's defaults.
PREFERRED = ("[data-listing-id]", "[data-vehicle-id]", "[itemtype*='Vehicle']", ".inventory-item", ".vehicle-card", "article", "li")
CONTAINERS, FALLBACK, LEAST, MOST_CLASSES = ("div", "article", "li", "section"), ".inventory-item, article, li", 3, 2
MODEL_MARK = "ds-inventory-model"
MODEL_CARDS = ".ds-vehicle-list-item, .srp-card, .vehicle-card, [class*='vehicle'][class*='item'], [class*='inventory'][class*='item']"
MODEL_LINKS = "a[href*='/pre-owned-cars/detail/'], a[href*='/vehicle-details/'], a[href*='/inventory/']"
MODEL_TITLES, MODEL_PRICES = "h1, h2, h3, h4, [itemprop='name']", ".price, [class*='price'], [class*='payment'], [class*='internet-price']"
MODEL_WAIT = ".ds-vehicle-list-item, .srp-card, [class*='vehicle'][class*='item'], a[href*='/pre-owned-cars/detail/']"
SCROLLS, CLICKS = 25, 30
_CLASS = re.compile(r"[a-zA-Z_][a-zA-Z0-9_-]*", re.ASCII)

FEATURES = "url string, preferred string, classes array<struct<name:string,n:int>>"


def linked_nodes(top: html.Node) -> set[int]:
    """Elements with a link below them, by identity: every link marks its ancestors once."""
    found: set[int] = set()
    for node in top.walk():
        if node.tag == "a" and "href" in node.attrs:
            up = node.parent
            while up is not None and id(up) not in found:
                found.add(id(up))
                up = up.parent
    return found


def dense(nodes: list[html.Node], linked: set[int]) -> bool:
    """At least two with links, and half of all."""
    n = sum(id(x) in linked for x in nodes)
    return n >= 2 and 2 * n >= len(nodes)


def page_features(page: str | None) -> tuple[str | None, list[tuple[str, int]]]:
    """The first well-known selector whose elements are dense in links, and how many linked containers have each class."""
    top = html.parse(page)
    linked = linked_nodes(top)
    preferred = next((s for s in PREFERRED if len(nodes := top.find(s)) >= 2 and dense(nodes, linked)), None)
    counts: dict[str, int] = {}
    for node in top.walk():
        if node.tag in CONTAINERS and id(node) in linked:
            for name in node.attrs.get("class", "").split():
                if _CLASS.fullmatch(name):
                    counts[name] = counts.get(name, 0) + 1
    return preferred, sorted(counts.items())


def features(pages: DataFrame) -> DataFrame:
    """``url, preferred, classes`` of landed pages (url, html), each parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [page_features(h) for h in rows["html"]]
            yield pd.DataFrame({"url": rows["url"], "preferred": [f[0] for f in found], "classes": [[{"name": n, "n": c} for n, c in f[1]] for f in found]})

    return map_pages(pages.select("url", "html"), run, FEATURES)


def common_classes(classes: Column) -> Column:
    """The two commonest classes of at least three containers; equal counts by name."""
    often = F.filter(classes, lambda c: c["n"] >= LEAST)
    ranked = F.array_sort(F.transform(often, lambda c: F.struct((-c["n"]).alias("less"), c["name"].alias("name"), c["n"].alias("n"))))
    return F.transform(F.slice(ranked, 1, MOST_CLASSES), lambda c: F.struct(c["name"].alias("name"), c["n"].alias("n")))


def card_selector(f: DataFrame) -> DataFrame:
    """``url, selector`` from ``features``."""
    by_class = F.array_join(F.transform(common_classes(F.col("classes")), lambda c: F.concat(F.lit("."), c["name"])), ", ")
    return f.select("url", F.coalesce("preferred", F.nullif(by_class, F.lit("")), F.lit(FALLBACK)).alias("selector"))


def with_platform_defaults(templates: DataFrame) -> DataFrame:
    """Templates with the defaults of the platform that their page (html) is of, where they state nothing of their own.

    Columns: html, cardSelector, urlSelector, titleSelector, priceSelector, waitSelectors, infiniteScroll,
    scrollMaxAttempts, clickMaxAttempts; others pass.
    """
    of = F.coalesce(F.lower("html").contains(MODEL_MARK), F.lit(False))
    plain = lambda c: text.trim(F.coalesce(F.col(c), F.lit("")))
    default = lambda c, value, *weak: F.when(of & plain(c).isin("", *weak), F.lit(value)).otherwise(F.col(c))
    bound = lambda c, value: F.when(of & (F.coalesce(F.col(c), F.lit(0)) <= 0), F.lit(value)).otherwise(F.col(c))
    return templates.withColumns({
        "cardSelector": default("cardSelector", MODEL_CARDS, "li"), "urlSelector": default("urlSelector", MODEL_LINKS, "a"), "titleSelector": default("titleSelector", MODEL_TITLES), "priceSelector": default("priceSelector", MODEL_PRICES),
        "waitSelectors": F.when(of & (F.size(F.coalesce("waitSelectors", F.array().cast("array<string>"))) == 0), F.array(F.lit(MODEL_WAIT))).otherwise(F.col("waitSelectors")),
        "infiniteScroll": of | F.coalesce("infiniteScroll", F.lit(False)), "scrollMaxAttempts": bound("scrollMaxAttempts", SCROLLS), "clickMaxAttempts": bound("clickMaxAttempts", CLICKS),
    })
