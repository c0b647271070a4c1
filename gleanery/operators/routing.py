"""Cache routing and run rules: which requests are answered from synced inventories, what such answers hold, when a cached
run may be used again, which failures are tried again, and which counts are shown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, urls
from ..functions.text import trim
from . import stores

# Stages whose counts no longer change much; redirects that no further attempt mends; passing errors.
STABLE_STAGES = ("items_deduped", "details_completed", "details_deduped", "ai_progress", "ai_completed", "completed")
UNSAFE_REDIRECTS = ("blocked redirect to local host", "blocked redirect to private host")
TRANSIENT_WORDS = ("context deadline exceeded", "client.timeout", "timeout", "temporary", "connection reset", "eof")
#: Stock numbers that say there is none (fixed values).
NO_STOCK = ("N/A", "NA", "NONE", "—", "-")


def route(requests: DataFrame, cache_only: DataFrame, protected: DataFrame, hosts: tuple[str, ...] = (), url: str = "request_url") -> DataFrame:
    """``requests`` with ``from_cache``: whether the URL is listed in ``cache_only`` or ``protected`` (both ``source_url``),
    or its host is one of ``hosts`` or of a protected URL. A flag holds for its whole host, a listed URL for itself only.
    A null URL is not served from the cache."""
    key, host = urls.cache_key(F.col("source_url")), urls.host_key(F.col("source_url"))
    keys = cache_only.select(key.alias("_key")).union(protected.select(key)).distinct().withColumn("_listed", F.lit(True))
    flagged = protected.select(host.alias("_host"))
    if hosts:
        flagged = flagged.union(requests.sparkSession.createDataFrame([(h,) for h in hosts], "_host string"))
    flagged = flagged.where("_host <> ''").distinct().withColumn("_flagged", F.lit(True))
    asked = requests.withColumns({"_key": urls.cache_key(F.col(url)), "_host": urls.host_key(F.col(url))})
    found = asked.join(keys, "_key", "left").join(flagged, "_host", "left")
    return found.select(*requests.columns, F.coalesce("_listed", "_flagged", F.lit(False)).alias("from_cache"))


def answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """A run for each request that is served from the cache: a success of the cached rows (of the exact URL, else the
    freshest of its host), or a failure with ``CACHE_NOT_FOUND`` where nothing was synced yet."""
    held = stores.latest(cache.select("source_url", "updated_at", "items"), ["source_url"], ["updated_at"]).withColumnRenamed("source_url", "cached_url")
    found = stores.lookup(requests, cache).drop("how").join(held, "cached_url", "left")
    hit, count = F.col("cached_url").isNotNull(), F.coalesce("items", F.lit(0))
    return found.select(
        "request_url", "cached_url", F.when(hit, "success").otherwise("failed").alias("status"), F.when(hit, "").otherwise("CACHE_NOT_FOUND").alias("code"),
        F.when(hit, "completed_from_cache").otherwise("").alias("progress_stage"), count.alias("total_items"), count.alias("success_items"), hit.cast("int").alias("attempts"),
    )


def is_unsafe_redirect(message: Column) -> Column:
    return identity.contains_any(F.lower(message), UNSAFE_REDIRECTS)


def is_transient(message: Column) -> Column:
    """Whether an error may pass by itself."""
    return ~is_unsafe_redirect(message) & identity.contains_any(F.lower(message), TRANSIENT_WORDS)


def retryable_runs(errors: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """``by, retry``: runs of ``counts`` without items are tried again, unless a redirect was refused as unsafe."""
    refused = errors.groupBy(*by).agg(F.max(F.coalesce(is_unsafe_redirect(F.col("message")), F.lit(False))).alias("_refused"))
    return counts.join(refused, by, "left").select(*by, ((F.col("items") == 0) & ~F.coalesce("_refused", F.lit(False))).alias("retry"))


def is_stable_stage(stage: Column) -> Column:
    return F.coalesce(stage.isin(*STABLE_STAGES), F.lit(False))


def shown_count(status: Column, stage: Column, total: Column, inventory: Column, rows: Column) -> Column:
    """The count a run is shown with: its inventory, else its stated total, else its rows; 0 while it may still change."""
    settled = F.when(inventory > 0, inventory).when((total == 0) & (rows > 0), rows).otherwise(total)
    return F.when((status == "running") & ~is_stable_stage(stage), 0).otherwise(settled)


def is_api_site(url: Column, host: str) -> Column:
    """Whether the URL is the inventory of the site ``host`` (with or without www), without user and port."""
    plain = F.lower(urls.authority(url)).rlike(rf"^(www\.)?{re.escape(host)}:?$")
    return F.lower(urls.scheme(url)).isin("http", "https") & plain & (F.regexp_replace(urls.path(url), "/+$", "") == "/inventory")


def fresh_for_site(runs: DataFrame, items: DataFrame, by: list[str], api_host: str) -> DataFrame:
    """``by, fresh`` of ``runs`` (``fresh, has_stock_selector, base_url``): whether a fresh run may be used again.

    Where a template has a stock selector, or the site is ``api_host``, every item needs a stock number that is not its
    vehicle number. The items of ``api_host`` also need a page of that host, a vehicle number of the usual form, and
    numbers that no other item of the run has. Runs without items pass both.
    """
    stock, vin = F.coalesce(F.nullif(trim(F.col("stockId")), F.lit("")), trim(F.col("stock")), F.lit("")), F.coalesce(trim(F.col("vin")), F.lit(""))
    up_stock, up_vin = F.upper(stock), F.upper(vin)
    page = F.lower(urls.scheme(F.col("url"))).isin("http", "https") & urls.authority(F.col("url")).rlike(rf"^(www\.)?(?i:{re.escape(api_host)}):?$") & urls.path(F.col("url")).startswith("/vehicle/")
    poor = (stock == "") | ((vin != "") & (F.lower(stock) == F.lower(vin)))
    odd = ~F.coalesce(page, F.lit(False)) | ~up_vin.rlike("^(?=.*[0-9])[A-HJ-NPR-Z0-9]{17}$") | up_stock.isin(*NO_STOCK)
    seen = items.select(*by, poor.alias("poor"), odd.alias("odd"), up_stock.alias("s"), up_vin.alias("v"))
    checks = seen.groupBy(*by).agg(F.max("poor").alias("_poor"), F.max("odd").alias("_odd"), (F.count("*") > F.least(F.countDistinct("s"), F.countDistinct("v"))).alias("_twice"))
    api = F.coalesce(is_api_site(F.col("base_url"), api_host), F.lit(False))
    bad = lambda c: F.coalesce(c, F.lit(False))
    refused = ((F.col("has_stock_selector") | api) & bad("_poor")) | (api & (bad("_odd") | bad("_twice")))
    return runs.join(checks, by, "left").select(*by, (F.col("fresh") & ~refused).alias("fresh"))


def canonical_source(dealer: Column, url: Column, moved: list[tuple[str, str, str, str]]) -> Column:
    """The URL, or the new one of the first of ``moved`` (dealer, host, path, new URL) that it agrees with."""
    host, path = F.lower(urls.hostname(url)), F.regexp_replace(F.lower(urls.path(url)), "/$", "")
    out = url
    for d, h, p, new in reversed(moved):
        out = F.when((F.lower(dealer) == d.lower()) & (host == h) & (path == p), F.lit(new)).otherwise(out)
    return out


def same_target(dealer: Column, url: Column, other_dealer: Column, other_url: Column, moved: list[tuple[str, str, str, str]]) -> Column:
    """Whether a stored run and a request are of one dealer and one source."""
    key = lambda d, u: urls.source_key(canonical_source(d, u, moved))
    return (F.lower(dealer) == F.lower(other_dealer)) & (key(dealer, url) == key(other_dealer, other_url))


def find_by_key(requests: DataFrame, runs: DataFrame, version: list[str], key: str = "idempotencyKey") -> DataFrame:
    """Requests joined to the run that holds their key; a blank key finds none. Of several runs, the last by ``version``."""
    held = stores.latest(runs.where(F.col(key) != ""), [key], version)
    return requests.join(held, key)


def release_keys(runs: DataFrame, keys: DataFrame, key: str = "idempotencyKey") -> DataFrame:
    """``runs`` with the keys that are in ``keys`` blanked."""
    freed = keys.select(F.col(key)).where(F.col(key) != "").distinct().withColumn("_freed", F.lit(True))
    return runs.join(freed, key, "left").withColumn(key, F.when(F.col("_freed"), "").otherwise(F.col(key))).select(*runs.columns)
