"""State that pages carry in their scripts, and the platforms' item rows made from landed pages.

A page is ``run_id, page_seq, url, html``. Objects are cut out of scripts by a brace scanner in Catalyst expressions: a page
is one row and is scanned once, without a shuffle. Where a platform's listing comes from its own service, the landed responses
are ``run_id, source_url, page_seq, payload``, and a page only tells that the platform is in use: they are joined by run and
source URL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import paginate, platforms
from .steps import step as passed

# What the platforms' pages and scripts hold.
DEALER_DOT_COM_STATE = r"""DDC\.WS\.state\[['"]ws-inv-data['"]\]\[['"][^'"]+['"]\]\s*=\s*"""
NEXT_DATA = r"""<script id="__NEXT_DATA__" type="application/json">"""
SPACE_AUTO_MARKS, SPACE_AUTO_ID = ("space.auto", "space-auto.com"), r"""\$space_id\s*=\s*["']([A-Za-z0-9_-]+)["']"""
SPACE_AUTO_SCRIPT, SPACE_AUTO_LINKS = r"""https?://[^"'\s]+/space/vehicles\.js[^"'\s]*""", r"""var\s+space_vehicles_json\s*=\s*(\[[\s\S]*?\])\s*;"""
SPACE_AUTO_LIMIT, SPACE_AUTO_MOST = 500, 5000
DEALER_ON_MARKS, DEALER_ON_IDS = ("dealeron_tagging_data", "vhcliaa"), r""""dealerId"\s*:\s*"?(\d+)"?\s*,\s*"pageId"\s*:\s*(\d+)"""
DEALER_SYNC_MARKS = ("ds-vehicle-list-item", "images.dealersync.com")
IMOTOR_MARK = "data-imotor-site"

_TOKENS = r'(?s)\\.?|"|[{}]|[^\\"{}]+'


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def object_at(source: Column) -> Column:
    """The brace-balanced object that ``source`` begins with; null where it begins otherwise or never closes.

    Braces inside string literals do not count; a backslash there takes the next character with it. What is inside of
    literals is blanked first, so that only braces are folded, not every token. Blanking takes no backslash outside of a
    literal; where one comes before the end, the text is folded token by token.
    """

    def step(s: Column, token: Column) -> Column:
        now = F.struct((s["depth"] + F.when(token.endswith("{"), 1).otherwise(-1)).alias("depth"), (s["length"] + F.char_length(token)).alias("length"))
        return F.when((s["length"] > 0) & (s["depth"] == 0), s).otherwise(now)

    def cut(s: Column) -> Column:
        pieces = F.split(F.regexp_replace(s, r"(?s)\\.", r"\\\\"), '"')
        bare = F.array_join(F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.translate(p, "{}\\", "___")).otherwise(p)), '"')
        return _with(bare, lambda b: _with(F.aggregate(F.regexp_extract_all(b, F.lit("[^{}]*[{}]"), F.lit(0)), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length")), step), lambda end: folded(s, b, end)))

    def folded(s: Column, bare: Column, end: Column) -> Column:
        closed = end["depth"] == 0
        seen = F.when(closed, F.substring(bare, F.lit(1), end["length"])).otherwise(bare)
        return F.when(seen.contains("\\"), _object_by_tokens(s)).when(closed, F.substring(s, F.lit(1), end["length"]))

    return F.when(source.startswith("{"), _with(source, cut))


def _object_by_tokens(source: Column) -> Column:
    """``object_at`` of a text that begins with a brace, whatever its backslashes."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("length"), F.lit(False).alias("closed"))

    def step(s: Column, token: Column) -> Column:
        escaped = token.startswith("\\")
        mark = F.when(escaped & s["quoted"], "").when(escaped, F.substring(token, 2, 1)).otherwise(token)
        quoted = s["quoted"] != (mark == '"')
        change = F.when(s["quoted"], 0).when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        depth = s["depth"] + change
        now = F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["length"] + F.char_length(token)).alias("length"), ((change == -1) & (depth == 0)).alias("closed"))
        return F.when(s["closed"], s).otherwise(now)

    end = F.aggregate(F.regexp_extract_all(source, F.lit(_TOKENS), F.lit(0)), state, step)
    return _with(end, lambda e: F.when(e["closed"], F.substring(source, F.lit(1), e["length"])))


def after(html: Column, pattern: str) -> Column:
    """What follows the first match of a pattern without groups; null without one."""
    return F.nullif(F.regexp_extract(html, f"(?s){pattern}(.*)$", 1), F.lit(""))


def state_object(html: Column, pattern: str) -> Column:
    """The object that follows the first match; a later match is not tried."""
    return _with(after(html, pattern), object_at)


def next_data(html: Column) -> Column:
    """The JSON of the page's data script; null without its end."""
    rest = after(html, NEXT_DATA)
    return F.when(rest.contains("</script>"), F.substring_index(rest, "</script>", 1))


def holds(html: Column, marks: tuple[str, ...], every: bool = False) -> Column:
    found = F.lit(every)
    for m in marks:
        found = (found & html.contains(m)) if every else (found | html.contains(m))
    return F.coalesce(found, F.lit(False))


def _payloads(pages: DataFrame, payload: Column) -> DataFrame:
    """Payloads are cut out of a page once: neither the filter nor what reads them repeats that."""
    return passed(pages.select("run_id", F.col("url").alias("source_url"), "page_seq", payload.alias("payload")), "payloads").where("payload is not null")


def _answered(pages: DataFrame, responses: DataFrame, rule: Column) -> DataFrame:
    """The responses to the pages that show the platform's marks."""
    shown = pages.where(rule).select("run_id", F.col("url").alias("source_url")).distinct()
    return responses.join(shown, ["run_id", "source_url"], "left_semi")


def dealer_dot_com(pages: DataFrame) -> DataFrame:
    """Item rows of the state in the pages' scripts; pages without a whole state give none."""
    return platforms.dealer_dot_com(_payloads(pages, state_object(F.col("html"), DEALER_DOT_COM_STATE)))


def dealer_dot_com_paging(pages: DataFrame) -> DataFrame:
    """``run_id, page_seq, url, total, size, start, further``: what the state says of the listing, and its other pages."""
    info = "WIS struct<pageInfo:struct<totalCount:int,pageSize:int,pageStart:int>,inventory:array<struct<vin:string>>>"
    state = passed(pages.select("run_id", "page_seq", "url", F.from_json(state_object(F.col("html"), DEALER_DOT_COM_STATE), info)["WIS"].alias("s")), "states").where("size(s.inventory) > 0")
    number = lambda name: F.coalesce(F.col(f"s.pageInfo.{name}"), F.lit(0))
    read = state.select("run_id", "page_seq", "url", number("totalCount").alias("total"), number("pageSize").alias("size"), number("pageStart").alias("start"))
    return read.withColumn("further", paginate.offset_urls(F.col("url"), F.col("total"), F.col("size")))


def driven_motion(pages: DataFrame, stores: DataFrame) -> DataFrame:
    """One store's vehicles from the pages' data scripts. ``stores`` is (slug, dealer_id), the slug what follows
    ``/inventory/`` in the page's path; pages of no known store give none."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(urls.path(F.col("url")), "/$", ""), "^/inventory|^/+|/+$", ""))
    named = pages.select("*", F.regexp_replace(slug, "^/+|/+$", "").alias("_slug")).join(stores.select(F.col("slug").alias("_slug"), "dealer_id"), "_slug")
    found = named.select("run_id", F.col("url").alias("source_url"), "page_seq", "dealer_id", next_data(F.col("html")).alias("payload"))
    return platforms.driven_motion(found, F.col("dealer_id"), "dealer_id")


def dealer_on(pages: DataFrame, responses: DataFrame) -> DataFrame:
    return platforms.dealer_on(_answered(pages, responses, holds(F.col("html"), DEALER_ON_MARKS, every=True) & F.col("html").rlike(DEALER_ON_IDS)))


def dealer_sync(pages: DataFrame, responses: DataFrame) -> DataFrame:
    return platforms.dealer_sync(_answered(pages, responses, holds(F.col("html"), DEALER_SYNC_MARKS)))


def imotor(pages: DataFrame, responses: DataFrame) -> DataFrame:
    return platforms.imotor(_answered(pages, responses, F.col("html").contains(IMOTOR_MARK)))


def vehicle_links(pages: DataFrame, scripts: DataFrame) -> DataFrame:
    """``run_id, source_url, vin, url, pos``: the detail pages that the sites' link scripts name.

    ``scripts`` is (url, body). A page's first link to a script counts, if it is on the page's own host. A script whose
    list does not parse gives none; entries without a number or URL are left out, and the last of a number wins by ``pos``.
    """
    script = F.nullif(F.regexp_extract("html", SPACE_AUTO_SCRIPT, 0), F.lit(""))
    linked = pages.select("run_id", F.col("url").alias("source_url"), script.alias("_script")).where(urls.same_host(F.col("source_url"), F.col("_script"))).distinct()
    entries = F.from_json(F.regexp_extract("body", SPACE_AUTO_LINKS, 1), "array<struct<url:string,vin:string>>")
    listed = scripts.select(F.col("url").alias("_script"), F.posexplode(entries).alias("pos", "e")).where("e.vin <> '' and e.url <> ''")
    return linked.join(listed, "_script").select("run_id", "source_url", F.upper("e.vin").alias("vin"), "e.url", "pos")


def bounded_responses(responses: DataFrame, limit: int = SPACE_AUTO_LIMIT, most: int = SPACE_AUTO_MOST) -> DataFrame:
    """The responses of a search that is read ``limit`` at a time, up to the first that is not full, that reaches the stated
    total, or that begins at ``most``. Empty ones end it and give nothing."""
    read = F.from_json("payload", "total int, vehicles array<struct<vin:string>>")
    count = F.greatest(F.coalesce(F.size(F.col("_r.vehicles")), F.lit(0)), F.lit(0))
    counted = responses.withColumn("_r", read).withColumn("_n", count)
    before = Window.partitionBy("run_id", "source_url").orderBy("page_seq")
    so_far = F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce(F.col("_r.total"), F.lit(0))
    counted = counted.withColumns({"_last": (F.col("_n") < limit) | ((total > 0) & (so_far >= total)), "_at": (F.row_number().over(before) - 1) * limit})
    ended = F.coalesce(F.max("_last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return counted.withColumn("_ended", ended).where(~F.col("_ended") & (F.col("_n") > 0) & (F.col("_at") < most)).select(*responses.columns)


def space_auto(pages: DataFrame, responses: DataFrame, scripts: DataFrame) -> DataFrame:
    """Vehicles of the search's responses, with the detail pages of the site's own link script."""
    shown = holds(F.col("html"), SPACE_AUTO_MARKS) & F.col("html").rlike(SPACE_AUTO_ID)
    answered = bounded_responses(_answered(pages, responses, shown))
    return platforms.space_auto(answered, vehicle_links(pages.where(shown), scripts))
