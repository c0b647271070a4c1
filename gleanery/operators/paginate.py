"""Further pages of a listing: numbers from pager texts and attributes, URLs by query parameter, the bounded walk."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .steps import written

#: How pagers state their page and totals, and the bounds of a walk.
PAGE_OF = r"(?i)page[\s]*:?[\s]*([0-9]+)[\s]+of[\s]+([0-9]+)"
SHOWING = r"(?i)showing[\s]*([0-9]+)[\s]*-[\s]*([0-9]+)[\s]*of[\s]*([0-9]+)"
TOTALS = (r"(?i)(?:[0-9]+\s*[-–—]\s*[0-9]+\s+of\s+|total\s+)([0-9][0-9,]{0,8})\s*(?:vehicles?|cars?|results?|inventory|listings?)?", r"(?i)(?<![A-Za-z0-9_])([0-9][0-9,]{0,8})\s+(?:vehicles?|cars?|results?|listings?)\s+available(?![A-Za-z0-9_])")
MOST_LINKED, MOST_OFFSETS, MAX_PAGES, MOST_STATED, MOST_SECTION_PAGES = 500, 120, 20, 200, 15
NO_CARDS, NOT_LANDED = "pagination page returned zero inventory cards", "page not landed"


def number(c: Column) -> Column:
    """A non-negative number, else 0. An empty text is not cast: the failed cast would raise and catch an error a row."""
    return F.greatest(F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("int"), F.lit(0)), F.lit(0))


def group_number(text: Column, pattern: str, k: int) -> Column:
    return number(F.translate(F.regexp_extract(text, pattern, k), ",", ""))


def total(text: Column) -> Column:
    """A stated inventory size: "1 - 20 of 148 vehicles", "total 148", "148 cars available"; else 0."""
    first, second = (group_number(text, p, 1) for p in TOTALS)
    return F.when(first > 0, first).otherwise(second)


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """The URL with a query parameter set: its parameters are written anew, by name, values of one name in their order.

    Pairs that do not decode, and those with a semicolon, are left out.
    """
    text = lambda c: F.try_url_decode(c)
    pairs = F.transform(F.split(F.substring(urls.query(url), 2, 1 << 30), "&"), lambda p: F.struct(text(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), text(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v"), p.alias("raw")))
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & ~p["raw"].contains(";") & (p["raw"] != "") & (p["k"] != name))
    own = F.array(F.struct(F.lit(name).alias("k"), value.cast("string").alias("v")))
    every = F.concat(F.transform(kept, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))), own)
    placed = F.array_sort(F.transform(every, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    escaped = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(placed, lambda p: F.concat(escaped(p["k"]), F.lit("="), escaped(p["v"]))), "&")
    return F.concat(urls.part(url, 1), urls.part(url, 3), urls.path(url), F.lit("?"), query, urls.part(url, 8))


def pages_between(url: Column, name: str, first: Column, last: Column, step: int | Column = 1) -> Column:
    """URLs with the parameter at ``first`` to ``last`` times ``step``; none if there are none between."""
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda n: with_parameter(url, name, n * step))


def page_of_urls(url: Column, pager: Column) -> Column:
    """"Page X of Y": the rest by ``PageNumber``, with a page size of 100 where none is given."""
    now, all_pages = group_number(pager, PAGE_OF, 1), group_number(pager, PAGE_OF, 2)
    sized = F.when(urls.query(url).rlike(r"[?&]PageSize=[^&]"), url).otherwise(with_parameter(url, "PageSize", F.lit(100)))
    return F.when(now > 0, pages_between(sized, "PageNumber", now + 1, all_pages)).otherwise(F.array().cast("array<string>"))


def showing_urls(url: Column, pager: Column) -> Column:
    """"Showing a - b of n": the rest by ``Paging.Page``."""
    a, b, n = (group_number(pager, SHOWING, k) for k in (1, 2, 3))
    size = F.greatest(b - a + 1, F.lit(1))
    now, last = F.floor((a - 1) / size).cast("int") + 1, F.ceil(n / size).cast("int")
    return F.when((a > 0) & (b >= a) & (n > b), pages_between(url, "Paging.Page", now + 1, last)).otherwise(F.array().cast("array<string>"))


def counted_urls(url: Column, count: Column, name: str = "page", stated: Column | None = None) -> Column:
    """A stated page count: the rest by a parameter, from the URL's, else the stated, else the first page on."""
    now = F.greatest(F.coalesce(F.nullif(urls.query_int(url, name), F.lit(0)), stated if stated is not None else F.lit(0)), F.lit(1))
    return F.when(count > 1, pages_between(url, name, now + 1, count)).otherwise(F.array().cast("array<string>"))


def offset_urls(url: Column, items: Column, size: Column) -> Column:
    """All offsets by ``start``, at most 120 pages."""
    last = F.least(F.ceil(items / F.greatest(size, F.lit(1))).cast("int"), F.lit(MOST_OFFSETS)) - 1
    return F.when((size > 0) & (items > size), pages_between(url, "start", F.lit(1), last, size)).otherwise(F.array().cast("array<string>"))


def zero_based_url(url: Column, items: Column, size: Column) -> Column:
    """The next ``ai_page`` while there is one."""
    following = urls.query_int(url, "ai_page") + 1
    last = F.ceil(items / F.greatest(size, F.lit(1)))
    return F.when((size > 0) & (items > size) & (following < last), with_parameter(url, "ai_page", following))


def elided(linked: Column) -> Column:
    """The page numbers between 2 and the highest linked that no link names."""
    top = F.coalesce(F.array_max(linked), F.lit(0))
    return F.when((top > 1) & (top <= MOST_LINKED), F.array_except(F.sequence(F.lit(2), F.greatest(top, F.lit(2))), linked)).otherwise(F.array().cast("array<int>"))


def elided_urls(template: Column, name: str, linked: Column) -> Column:
    """The URLs of the pages that ``elided`` gives."""
    return F.transform(elided(linked), lambda n: with_parameter(template, name, n))


class Walk(NamedTuple):
    """``pages``: run_id, page_seq (from 1), url. ``refused``: run_id, url, message, and the link's parent page and place."""

    pages: DataFrame
    refused: DataFrame


def judged(landed: DataFrame) -> DataFrame:
    """``url, message`` of landed pages (url, cards, served): why a page is not taken, else null. ``served`` is the page that
    the pager says it is, 0 if it says nothing; ``cards`` is null where the site has no card selector."""
    asked, served = urls.page_number(F.col("url")), F.coalesce("served", F.lit(0))
    other = F.concat(F.lit("requested page "), asked.cast("string"), F.lit(" but got page "), served.cast("string"))
    return landed.select("url", F.when(F.col("cards") == 0, NO_CARDS).when((asked > 1) & (served > 0) & (served != asked), other).alias("message"))


def walk(landed: DataFrame, links: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES) -> Walk:
    """The pages reached from each run's first, in the order in which a queue finds them, and those refused on the way.

    ``landed`` is (url, message) as ``judged`` gives it; ``links`` is (url, place, next_url), a page's links in order; ``starts``
    is (run_id, url) and may hold each run's own ``max_pages``. A page is found by the first link to it, of the first page
    that links it. A page that is not landed or has a message is refused, anew for every link to it that is read before the
    run has its pages. Each turn is one join of the last turn's pages with their links, so turns are as many as the longest
    way; a run's pages of a turn are numbered together, and are fewer than its bound times a page's links.
    """
    most = F.col("max_pages") if "max_pages" in starts.columns else F.lit(max_pages)
    first = written(starts.select("run_id", "url", F.lit(1).alias("page_seq"), most.cast("int").alias("most")).dropDuplicates(["run_id"]), "walk-starts")
    seen, refused = first, None
    frontier = first.withColumn("found", F.lit(1)).where("found < most")
    known = landed.select(F.col("url").alias("next_url"), "message", F.lit(True).alias("here"))
    known, links = written(known.dropDuplicates(["next_url"]), "walk-known"), written(links, "walk-links")  # read anew every turn
    turn_order = Window.partitionBy("run_id").orderBy("at")
    while True:
        reached = frontier.join(links, "url").select("run_id", "most", "found", F.struct(F.col("page_seq").alias("parent"), F.col("place").alias("place")).alias("at"), F.col("url").alias("from_url"), "next_url")
        new = reached.join(seen.select("run_id", F.col("url").alias("next_url")), ["run_id", "next_url"], "left_anti").join(known, "next_url", "left")
        new = written(new.withColumn("message", F.when(F.col("here"), F.col("message")).otherwise(NOT_LANDED)).drop("here"), "walk-reached")
        taken = new.where("message is null").groupBy("run_id", "most", "found", F.col("next_url").alias("url")).agg(F.min("at").alias("at"))
        taken = taken.withColumn("page_seq", F.col("found") + F.row_number().over(turn_order)).where(F.col("page_seq") <= F.col("most"))
        taken = written(taken.withColumn("found", F.max("page_seq").over(Window.partitionBy("run_id"))), "walk-taken")
        full = taken.where(F.col("page_seq") == F.col("most")).select("run_id", F.col("at").alias("last"))
        left = new.where("message is not null").join(full, "run_id", "left").where(F.col("last").isNull() | (F.col("at") < F.col("last")))
        left = left.select("run_id", F.col("next_url").alias("url"), "message", "from_url", F.col("at.parent").alias("parent_seq"), F.col("at.place").alias("place"))
        refused = left if refused is None else refused.unionByName(left)
        seen = seen.unionByName(taken.select("run_id", "url", "page_seq", "most"))
        frontier = taken.where("found < most").select("run_id", "url", "page_seq", "most", "found")
        if frontier.isEmpty():
            return Walk(seen.select("run_id", "page_seq", "url"), refused)


def bounds(starts: DataFrame, features: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``run_id, url, max_pages``: the site's bound, or the page count that the first page's result counts state where that
    is more, up to 200. ``features`` is (url, stated_total, stated_count)."""
    pages = stated_pages(F.col("stated_total"), F.col("stated_count"))
    known = starts.join(features.dropDuplicates(["url"]), "url", "left")
    return known.select("run_id", "url", F.when(pages > max_pages, F.least(pages, F.lit(MOST_STATED))).otherwise(max_pages).alias("max_pages"))


def stated_pages(total: Column, count: Column) -> Column:
    """The pages that a result total and a page's count make, at least one; 0 where either is missing."""
    return F.when((total > 0) & (count > 0), F.greatest(F.ceil(total / count), F.lit(1)).cast("int")).otherwise(0)


def remaining_zero_based(url: Column, items: Column, size: Column) -> Column:
    """All following ``ai_page`` URLs."""
    last = F.ceil(items / F.greatest(size, F.lit(1))).cast("int") - 1
    return F.when((size > 0) & (items > size), pages_between(url, "ai_page", urls.query_int(url, "ai_page") + 1, last)).otherwise(F.array().cast("array<string>"))


def first_added(cards: DataFrame, keys: list[str], sections: list[str], pages: int = MOST_SECTION_PAGES) -> DataFrame:
    """Cards of sections that are read page by page until one adds nothing new; ``keys`` tell a run.

    ``cards`` is (keys, section, page, pos, key): the landed pages' cards. Sections are read in the given order, pages from 1
    to ``pages``. A card counts where its key (trimmed, in lower case) is seen first
    among all pages that are read; a page without a new card, or that is missing, ends its section. Cards without a key
    never count. Returned: the cards that count, in a run's order (section, page, pos).

    The sections are settled one after the other: what counts in a section depends on those before it only. Within one,
    each key's first page is an aggregation, pages that are first for no key end the prefix, and as later pages cannot make
    an earlier one add something, one pass settles it.
    """
    number = F.lower(F.trim("key"))
    rows = written(cards.withColumn("_key", number).where("_key <> ''").where(F.col("page").between(1, pages)), "section-cards")
    kept = None
    for section in sections:
        own = rows.where(F.col("section") == section)
        if kept is not None:
            own = own.join(kept.select(*keys, "_key"), [*keys, "_key"], "left_anti")
        first = own.groupBy(*keys, "_key").agg(F.min(F.struct("page", "pos")).alias("at"))
        adding = first.groupBy(*keys, F.col("at.page").alias("page")).agg(F.count("*").alias("added"))
        run = F.row_number().over(Window.partitionBy(*keys).orderBy("page"))  # at most ``pages`` rows a run
        read = adding.withColumn("_nth", run).where("_nth = page").groupBy(*keys).agg(F.max("page").alias("last"))
        counted = own.join(first.select(*keys, "_key", "at"), [*keys, "_key"]).where((F.col("at.page") == F.col("page")) & (F.col("at.pos") == F.col("pos")))
        counted = written(counted.drop("at").join(read, keys).where(F.col("page") <= F.col("last")).drop("last").dropDuplicates([*keys, "_key"]), f"section-{section}")
        kept = counted if kept is None else kept.unionByName(counted)
    return kept.drop("_key")
