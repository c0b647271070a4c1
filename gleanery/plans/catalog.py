"""Registered queries of the engine's own operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, text, urls
from ..operators import dedupe as dd
from ..operators import diagnostics as dg
from ..operators import extract, paginate, platforms, routing, stores
from ..operators import inventory as inv
from ..operators import normalize as nz
from ..operators.steps import dealt, step
from . import pipeline
from .samples import items, raw_items, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The moment that freshness rules are evaluated at (fixed, so that results repeat).
NOW = "2024-01-20 00:00:00"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _per_page(name: str, make: Callable[[Column], Column]) -> None:
    """Registers a query of one URL expression over the pages."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pages(spark, sf_dir).select("page_id", make(F.col("url")).alias("value"))

    QUERIES[name] = run


_per_page("url_key_canonical", urls.canonical_key)
_per_page("url_key_cache", urls.cache_key)
_per_page("url_key_source", urls.source_key)
_per_page("url_key_template", urls.template_key)
_per_page("url_host", urls.host_key)
_per_page("diagnostic_url", urls.diagnostic_url)
_per_page("page_number_param", urls.page_number)
_per_page("score_listing_url", inv.listing_score)
_per_page("paging_url", urls.is_paging)
_per_page("template_file_name", lambda u: urls.template_file(urls.template_key(u)))
_per_page("template_key_round_trip", lambda u: urls.template_key_of_file(urls.template_file(urls.template_key(u))))
_per_page("url_valid_unsafe", lambda u: F.concat_ws(",", urls.is_valid(u).cast("string"), urls.is_unsafe(u).cast("string")))
_per_page("resolve_relative", lambda u: urls.resolve(u, F.lit("../next/./page?p=2#top")))
_per_page("bare_self_link", lambda u: urls.is_bare_self_link(u, F.concat(F.lit("https://other.example"), urls.path(u))))


@query
def page_diagnostics(spark, sf_dir):
    return dg.page_diagnostics(_pages(spark, sf_dir))


@query
def page_dedupe_by_key(spark, sf_dir):
    keyed = _pages(spark, sf_dir).select("page_id", urls.canonical_key(F.col("url")).alias("key"))
    return keyed.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query
def host_counts(spark, sf_dir):
    keyed = _pages(spark, sf_dir).select(urls.host_key(F.col("url")).alias("host"), urls.canonical_key(F.col("url")).alias("key"))
    return keyed.groupBy("host").agg(F.countDistinct("key").alias("pages"))


@query
def anchor_candidates(spark, sf_dir):
    """Distinct links of a page (URL and text), first-seen order, at most 120 a page, text cut to 280 bytes: the limit
    is the operator's own."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>'), F.lit(1))
    shown = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    links = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(F.arrays_zip(found.alias("href"), shown.alias("label"))).alias("pos", "a"))
    rows = links.select("page_id", "pos", urls.resolve(F.col("url"), F.col("a.href")).alias("link"), text.byte_prefix(text.clean(F.regexp_replace("a.label", "<[^>]*>", "")), 280).alias("label"))
    first = rows.groupBy("page_id", "link", "label").agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("place <= 120").select("page_id", "place", "link", "label")


@query
def next_page_urls(spark, sf_dir):
    """Pages 2 to 4 of every listing whose URL has a page parameter, other parameters kept."""
    numbered = _pages(spark, sf_dir).where(urls.page_number(F.col("url")) > 0)
    return numbered.select("page_id", F.explode(paginate.counted_urls(F.col("url"), F.lit(4))).alias("next_url"))


@query
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@query
def block_predicate(spark, sf_dir):
    both = _pages(spark, sf_dir).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")).union(table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", "text"))
    return both.select("kind", "id", dg.is_challenge(F.col("body")).alias("challenge"), dg.block_marker(F.col("body")).alias("marker"))


@query
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned_md5"))


@query
def first_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_number(F.col("text")).alias("number"))


@query
def strip_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_label(F.concat(F.lit(" Engine : "), "p_name", F.when(F.col("p_partkey") % 3 == 0, "Miles: 43K").otherwise(""))).alias("value"))


@query
def mileage_norm(spark, sf_dir):
    return raw_items(spark, sf_dir).select("seq", text.mileage(F.col("mileage")).alias("value"))


@query
def stock_norm(spark, sf_dir):
    s = identity.stock_number(F.col("stock_id"))
    return raw_items(spark, sf_dir).select("seq", s.alias("value"), identity.is_missing_stock(s).alias("missing"), identity.plausible_stock(s).alias("plausible"))


@query
def vin_valid(spark, sf_dir):
    return raw_items(spark, sf_dir).select("seq", identity.valid_vin(F.col("vin")).alias("valid"), identity.structured_vin(F.substring("vin", 1, 13)).alias("short"), identity.vin_in_text(F.concat(F.lit("see vin "), "vin", F.lit(" now"))).alias("in_text"))


@query
def vin_from_path(spark, sf_dir):
    return raw_items(spark, sf_dir).select("seq", identity.vin_in_path(F.concat(F.lit("https://a.example/new/"), "vin", F.lit("/x"))).alias("value"))


@query
def listing_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.listing_id(F.concat(F.lit("https://a.example/2022/"), F.when(F.col("o_orderkey") % 3 == 0, "car-").otherwise(""), F.col("o_orderkey").cast("string"), F.lit("/"))).alias("value"))


@query
def mpg_conversion(spark, sf_dir):
    size = F.concat(F.col("p_size").cast("string"), F.lit(" combined"))
    return table(spark, sf_dir, "part").select("p_partkey", text.mpg_value(size).alias("mpg"), text.miles_per_litre(size).alias("mpl"))


@query
def image_likely(spark, sf_dir):
    return raw_items(spark, sf_dir).select("seq", identity.is_vehicle_image(F.col("primary_image")).alias("likely"), identity.is_vehicle_image(F.concat(F.lit("https://c.example/car-"), (F.col("seq") % 700).cast("string"), F.lit("x400.jpg"))).alias("sized"))


@query
def image_filter_size(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    images = part.select("p_partkey", F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("url"))
    sizes = part.where("p_partkey % 5 <> 0").select(F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("url"), (F.col("p_size") * 20).alias("w"), (F.col("p_size") * 15).alias("h"))
    return nz.filter_images_by_size(images, sizes)


@query
def normalize_items(spark, sf_dir):
    out = nz.normalize(items(spark, sf_dir))
    return out.select("seq", "title", "stockId", "vin", "url", "price", "mileage", "primaryImage", "year", "make", "model")


@query
def title_make_model(spark, sf_dir):
    out = nz.normalize(items(spark, sf_dir))
    return out.groupBy("year", "make", "model").agg(F.count("*").alias("n"))


@query
def infer_style(spark, sf_dir):
    return raw_items(spark, sf_dir).select("seq", text.infer_style(F.col("title")).alias("style"))


@query
def item_aliases(spark, sf_dir):
    out = nz.aliases(nz.with_item_columns(items(spark, sf_dir)))
    return out.select("seq", "stock", "website", "dealerId", "vehicleListPrice", "style", F.size("photoURLs").alias("photos"))


@query
def dedupe_keys(spark, sf_dir):
    return dd.with_dedupe_key(nz.normalize(items(spark, sf_dir))).select("seq", "key")


@query
def dedupe_items(spark, sf_dir):
    """Groups of the key ladder with its rule on conflicting vehicle numbers: first row, rows, first non-empty fields."""
    fields = ("vin", "url", "price", "mileage", "primaryImage")
    grouped = dd.grouped(nz.normalize(items(spark, sf_dir)), ["dealer_id"], fields).withColumnRenamed("group", "grp")
    filled = lambda n: F.coalesce(F.min_by(n, F.when(F.col(n) != "", F.col("seq"))), F.lit("")).alias(n)
    return grouped.groupBy("dealer_id", "grp").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), *[filled(n) for n in fields])


@query
def dedupe_items_full(spark, sf_dir):
    texts = ("stockId", "vin", "url", "title", "model", "price", "mileage", "primaryImage")
    out = dd.dedupe(nz.normalize(items(spark, sf_dir)), ["dealer_id"], (*texts, "images"))
    return out.select("dealer_id", "seq", *texts, F.size("images").alias("n_images"))


@query
def merge_fill_missing(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("dealer_id"), F.concat(F.lit("$"), F.floor("s_acctbal").cast("string")).alias("price"), F.col("s_name").alias("mileage"))
    return nz.fill_missing(raw_items(spark, sf_dir), found, "dealer_id", ["price", "mileage"]).select("seq", "price", "mileage")


@query
def valid_items(spark, sf_dir):
    rows = nz.with_item_columns(items(spark, sf_dir))
    return rows.select("seq", inv.is_credible().alias("credible"), inv.is_useful_listing().alias("useful"), inv.is_complete().alias("complete"))


@query
def invalid_count(spark, sf_dir):
    return inv.invalid_errors(nz.with_item_columns(items(spark, sf_dir)), ["dealer_id"])


@query
def inventory_counts(spark, sf_dir):
    return inv.inventory_counts(nz.normalize(items(spark, sf_dir)), ["dealer_id"])


@query
def details_needed(spark, sf_dir):
    return inv.details_needed(nz.with_item_columns(items(spark, sf_dir)), ["dealer_id"], 100)


@query
def detail_join(spark, sf_dir):
    """Vehicle number to page URL with a default where none is known."""
    known = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("vin"), F.concat(F.lit("/car/"), "p_name").alias("found"))
    sold = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("own"))
    joined = sold.join(known, F.upper("own") == known["vin"], "left").select("own", F.coalesce("found", F.concat(F.lit("/vehicle/"), F.lower("own"), F.lit("/"))).alias("url"))
    return joined.groupBy("own", "url").agg(F.count("*").alias("n"))


@query
def strict_snapshot(spark, sf_dir):
    """Orders whose lines have unique parts and suppliers and as many lines as the highest line number states."""
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    stated = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("stated"))
    return inv.strict_snapshot(lines.join(stated, "l_orderkey"), ["l_orderkey"], "l_partkey", "l_suppkey", "stated").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query
def listing_post_join(spark, sf_dir):
    """Orders joined to the customers of their nation's runs, none where an order has no customer below 1,000."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    posts = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 0").select("c_custkey", "c_nationkey")
    joined, _ = inv.inner_or_fail(orders.withColumn("run", F.col("c_custkey") % 20), posts, "c_custkey", ["run"])
    return joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "run", "n_name")


@query
def json_pick(spark, sf_dir):
    """First non-blank of several spellings of a key, matched without case and separators, from the events' JSON."""
    pairs = F.from_json("props", "map<string,string>")
    loose = F.transform_keys(pairs, lambda k, v: F.lower(F.translate(k, "_- ", "")))
    pick = lambda *keys: F.coalesce(*[F.nullif(text.trim(F.try_element_at(loose, F.lit(k))), F.lit("")) for k in keys], F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", pick("page", "pageid").alias("page"), pick("k", "key", "ref").alias("other"))


@query
def regex_extract_rows(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.lit(1).alias("page_seq"), F.lit("").alias("url"), F.col("text").alias("html"))
    found = extract.pattern_rows(pages, [r"(?i)(?:key|token|secret)\s*[:=]\s*\"?([A-Za-z0-9]+)"])
    return found.select(F.col("run_id").alias("doc_id"), "pos", F.col("item.stockId").alias("value"))


@query
def run_status(spark, sf_dir):
    """Events as attempts: purchases are items, errors are errors, the first error's id is kept."""
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("items"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min_by("event_id", F.when(F.col("event_type") == "error", F.col("ts"))).alias("first_error"))
    return runs.select("user_id", "items", "errors", inv.run_status(F.col("items"), F.col("errors")).alias("status"), "first_error")


@query
def ring_bound(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("log", F.col("user_id") % 5)
    return dg.bounded_events(events, ["log"], ["ts", "event_id"]).select("log", "event_id", "place", "dropped")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cached pages in three, updated at hours that follow from their ids."""
    at = F.timestamp_seconds(F.lit(1705276800) + (F.col("page_id") * 3571) % 432000)
    return _pages(spark, sf_dir).where("page_id % 3 <> 0").select(F.col("url").alias("source_url"), at.alias("updated_at"), (F.col("page_id") % 40).alias("items"))


@query
def latest_per_host(spark, sf_dir):
    return stores.freshest_by_host(_cache(spark, sf_dir)).select("host", "source_url", "updated_at", "items")


@query
def cache_lookup(spark, sf_dir):
    return stores.lookup(_pages(spark, sf_dir).select(F.col("url").alias("request_url")), _cache(spark, sf_dir))


@query
def cache_fresh_24h(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    fresh = stores.is_fresh(status, F.floor("value").cast("int"), F.when(F.col("event_id") % 4 != 0, F.col("ts")), F.col("ts"), F.lit(NOW).cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", fresh.alias("fresh"))


@query
def pending_sync(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", F.col("url").alias("source_url"))
    return stores.pending(pages.where("page_id % 4 = 0"), pages.where("page_id % 6 <= 1"), _cache(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query
def shrink_guard(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("late", F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp"))
    counts = lines.groupBy("l_suppkey").agg(F.count_if(~F.col("late")).alias("old"), F.count_if("late").alias("new"))
    return counts.select("l_suppkey", "old", "new", stores.survives_shrink(F.col("new"), F.col("old")).alias("kept"))


@query
def schedule_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    minutes = F.when(F.col("c_custkey") % 4 == 0, 10080).when(F.col("c_custkey") % 4 == 1, 1440).otherwise(0)
    label = F.when(F.col("c_custkey") % 3 == 0, " Weekly ").when(F.col("c_custkey") % 3 == 1, "")
    flag = lambda k: F.when(F.col("c_custkey") % k == 0, True).when(F.col("c_custkey") % k == 1, False)
    ftp, scrape, sheet = stores.sync_flags(flag(3), flag(4), flag(5), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("https://s.example"))
    return c.select("c_custkey", stores.matches_schedule(minutes, label, "daily").alias("daily"), stores.matches_schedule(minutes, label, "weekly").alias("weekly"), ftp.alias("ftp"), scrape.alias("scrape"), sheet.alias("sheet"))


@query
def keyed_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return stores.upsert(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query
def keyed_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return stores.delete(orders, table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query
def elided_pages(spark, sf_dir):
    """Page numbers between 2 and the highest linked one that no link names."""
    linked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set((F.col("l_linenumber") * 2).cast("int"))).alias("linked"))
    return linked.select("l_orderkey", F.explode(paginate.elided(F.col("linked"))).alias("page"))


@query
def metrics_rollup(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.lit(1).alias("items"), F.floor("value").alias("seconds"))
    return dg.run_metrics(runs)


@query
def scoped_keys(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" k"), F.col("page_id").cast("string"))).otherwise(" ")
    return pages.select("page_id", stores.scoped_key(raw, F.lit("d1"), F.col("url")).alias("scoped"), stores.once_key(F.lit("d1"), F.col("url")).alias("once"))


@query
def error_predicates(spark, sf_dir):
    """Which of the documents, read as error messages, look like blocks or timeouts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", inv.is_block_error(F.lit("SCRAPE_RENDER_FAILED"), F.col("text")).alias("block"), inv.is_timeout_error(F.col("text")).alias("timeout"))


@query
def run_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", F.when(F.col("event_id") % 2 == 0, "FALLBACK_EMPTY").otherwise("OTHER").alias("code"), F.col("event_id").cast("string").alias("message"))
    counts = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("items"))
    return inv.run_errors(errors, counts, ["user_id"])


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as one run a host, in order of their ids."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("page_id"))
    return _pages(spark, sf_dir).withColumn("run_id", urls.host_key(F.col("url"))).select("run_id", place.alias("page_seq"), "url", "html")


SITE = {"cardSelector": "article", "titleSelector": "h1", "urlSelector": "a[href]", "imageSelector": "img", "stockPatterns": []}


@query
def dom_extract(spark, sf_dir):
    """Cards (articles) of the pages with their titles: the tree is parsed in Arrow batches."""
    return extract.structured_rows(_landed(spark, sf_dir), SITE).select("run_id", "page_seq", "pos", text.clean(F.col("item.title")).alias("title"))


@query
def extract_pipeline(spark, sf_dir):
    return pipeline.run(_landed(spark, sf_dir), SITE).runs


def _payloads(spark: SparkSession, sf_dir: str, path: list[str], **fields: Column) -> DataFrame:
    """Parts by size as landed payloads of a platform: JSON with the listings under ``path``."""
    body = F.sort_array(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()])))
    for name in reversed(path):
        body = F.array(body) if name == "[]" else F.struct(body.alias(name))
    made = table(spark, sf_dir, "part").groupBy("p_size").agg(F.to_json(body).alias("payload"))
    return made.select(F.lit("r").alias("run_id"), F.lit("https://a.example/x").alias("source_url"), F.col("p_size").alias("page_seq"), "payload")


@query
def platform_imotor(spark, sf_dir):
    c = F.col
    hit = F.struct(c("p_partkey").alias("id"), F.when(c("p_partkey") % 2 == 0, "New").alias("vehType"), c("p_brand").alias("make"), c("p_type").alias("model"), (1990 + c("p_size")).alias("year"), c("p_retailprice").alias("price"))
    hits = table(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_list(hit).alias("hits"))
    landed = hits.select(F.lit("r").alias("run_id"), F.lit("https://a.example/x").alias("source_url"), F.col("p_size").alias("page_seq"), F.to_json(F.struct(F.array(F.struct("hits")).alias("results"))).alias("payload"))
    return platforms.imotor(landed).select("stockId", "title", "url")


@query
def platform_dealer_sync(spark, sf_dir):
    c = F.col
    landed = _payloads(spark, sf_dir, ["Vehicles"], Vin=F.concat(F.lit("v"), (c("p_partkey") % 90).cast("string")), StockNo=c("p_partkey").cast("string"), Year=(1990 + c("p_size")).cast("string"), Make=c("p_brand"), InternetPrice=F.floor("p_retailprice").cast("double"), VehicleDetailUrl=F.concat(F.lit("/v/"), c("p_partkey").cast("string")))
    return platforms.dealer_sync(landed).groupBy("vin").agg(F.count("*").alias("n"))


@query
def platform_space_auto(spark, sf_dir):
    c = F.col
    landed = _payloads(spark, sf_dir, ["vehicles"], vin=F.concat(F.lit("v"), c("p_partkey").cast("string")), make=c("p_brand"), price=F.floor("p_retailprice").cast("double"), mileage=(c("p_partkey") * 7).cast("double"))
    links = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("V"), c("p_partkey").cast("string")).alias("vin"), F.concat(F.lit("/car/"), c("p_partkey").cast("string")).alias("url"), F.lit(0).alias("pos"))
    return platforms.space_auto(landed, links).select("title", "url", "price", "mileage")


@query
def paging_urls(spark, sf_dir):
    """Further pages of each URL under each pager rule, for pagers made from the page ids."""
    pages, u = _pages(spark, sf_dir), F.col("url")
    n = (F.col("page_id") % 4).cast("int")
    made = pages.select("page_id", paginate.counted_urls(u, n).alias("counted"), paginate.offset_urls(u, n * 15, F.lit(10)).alias("offsets"), paginate.page_of_urls(u, F.concat(F.lit("Page 1 of "), n.cast("string"))).alias("stated"))
    return made.select("page_id", F.size("counted").alias("counted"), F.size("offsets").alias("offsets"), F.size("stated").alias("stated"))


@query
def inventory_total(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", paginate.total(F.concat(F.lit("Showing 1 - "), F.col("p_size").cast("string"), F.lit(" of "), F.format_number(F.col("p_partkey") * 7, 0), F.lit(" vehicles"))).alias("total"))


@query
def capped_items(spark, sf_dir):
    return inv.capped(raw_items(spark, sf_dir), ["dealer_id"], 20).select("dealer_id", "seq")


@query
def template_resolution(spark, sf_dir):
    """URLs whose site has a template, of templates for every second host."""
    named = _pages(spark, sf_dir).select("page_id", "url", urls.host_key(F.col("url")).alias("host"))
    known = named.groupBy("host").agg(F.min("page_id").alias("first")).where("first % 2 = 0").select("host")
    return named.join(known, "host", "left_semi").select("page_id", "host")


@query
def cache_routing(spark, sf_dir):
    """Which URLs (made from the page ids, of 97 hosts) are answered from the cache: some hosts are flagged, some URLs listed."""
    host = F.col("page_id") % 97
    u = F.concat(F.lit("https://"), F.when(F.col("page_id") % 2 == 0, "www.").otherwise(""), F.lit("h"), host.cast("string"), F.lit(".example/used?x="), (F.col("page_id") % 5).cast("string"))
    asked = _pages(spark, sf_dir).select("page_id", host.alias("k"), u.alias("request_url"))
    listed = lambda rule: asked.where(rule).select(F.col("request_url").alias("source_url"))
    out = routing.route(asked, listed("k >= 90 and page_id % 5 = 1"), listed("k < 10 and page_id % 5 = 0"), ("h50.example",))
    return out.select("page_id", "from_cache")


@query
def cache_answers(spark, sf_dir):
    return routing.answers(_pages(spark, sf_dir).select(F.col("url").alias("request_url")), _cache(spark, sf_dir))


@query
def failure_retries(spark, sf_dir):
    """Users as runs: which are tried again, and how many of their errors may pass."""
    events = table(spark, sf_dir, "events")
    message = F.when(F.col("event_id") % 7 == 0, "Blocked redirect to LOCAL host, timeout").when(F.col("event_id") % 3 == 0, "read: Connection reset").otherwise("HTTP 500")
    errors = events.where("event_type = 'error'").select("user_id", message.alias("message"))
    counts = events.groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0)).alias("items"))
    passing = errors.groupBy("user_id").agg(F.count_if(routing.is_transient(F.col("message"))).alias("transient"))
    return routing.retryable_runs(errors, counts, ["user_id"]).join(passing, "user_id", "left").select("user_id", "retry", F.coalesce("transient", F.lit(0)).alias("transient"))


@query
def shown_counts(spark, sf_dir):
    e = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("items_deduped", "details_started", "completed", "ai_progress")]), (e % 4 + 1).cast("int"))
    status = F.when(F.col("event_type") == "purchase", "running").otherwise("success")
    return table(spark, sf_dir, "events").select("event_id", routing.shown_count(status, stage, e % 5, e % 3, e % 7).alias("shown"))


@query
def site_freshness(spark, sf_dir):
    """Orders as cached runs, their lines as items: the templates of a third have a stock selector, a third are of the API site."""
    key, part = F.col("o_orderkey"), F.col("l_partkey")
    base = F.when(key % 3 == 0, "https://www.a.example/inventory/").otherwise("https://b.example/inventory")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", (key % 5 != 0).alias("fresh"), (key % 3 == 1).alias("has_stock_selector"), base.alias("base_url"))
    vin = F.concat(F.lit("1hgcm82633a"), F.lpad((part % 1000000).cast("string"), 6, "0"))
    stock = F.when(part % 11 == 0, " ").when(part % 13 == 0, F.upper(vin)).when(part % 17 == 0, "n/a").otherwise(F.concat(F.lit("S"), part.cast("string")))
    page = F.concat(F.when(part % 19 == 0, "https://a.example/about/").otherwise("https://A.example/vehicle/"), part.cast("string"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), stock.alias("stockId"), F.lit("").alias("stock"), vin.alias("vin"), page.alias("url"))
    return routing.fresh_for_site(runs, items, ["o_orderkey"], "a.example")


def _keyed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs that hold a key of their customer."""
    url = F.concat(F.lit("https://S.example/list"), (F.col("o_orderkey") % 3).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("idempotencyKey"), F.lit("D1").alias("dealer"), url.alias("source_url"))


MOVED = [("d1", "s.example", "/list2", "https://s.example/list1")]


@query
def idempotency_lookup(spark, sf_dir):
    """The last run that holds a request's key, and whether it is of the request's source."""
    key = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("k"), F.col("c_custkey").cast("string")))
    asked = table(spark, sf_dir, "customer").select("c_custkey", key.alias("idempotencyKey"))
    found = routing.find_by_key(asked, _keyed_runs(spark, sf_dir), ["o_orderkey"])
    return found.select("c_custkey", "o_orderkey", routing.same_target(F.col("dealer"), F.col("source_url"), F.lit("d1"), F.lit("https://s.example/list1/"), MOVED).alias("same"))


@query
def idempotency_release(spark, sf_dir):
    freed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("idempotencyKey"))
    return routing.release_keys(_keyed_runs(spark, sf_dir), freed).select("o_orderkey", "idempotencyKey")


from . import landed  # noqa: E402, F401  registers its queries
