"""Inventory that arrives from outside: syncs into the cache, upserts for accounts, and the crawl limits of a run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from . import stores
from .schedule import trigger

# Refusals, and why a synced URL is flagged.
BAD_URL, NO_OWNER, NO_ROWS, SYNCED = "valid url is required", "accountId and dealershipId are required", "no valid items to upsert (items must have stockId)", "cache-only hybrid sync"


class Synced(NamedTuple):
    """``cached`` rows of the cache, ``flagged`` URLs, ``inventory`` rows to upsert, and a ``responses`` row for each request."""

    cached: DataFrame
    flagged: DataFrame
    inventory: DataFrame
    responses: DataFrame


def owners(entries: DataFrame) -> DataFrame:
    """``key, dealershipId, accountID``: the owner of each URL's cache key, of the first entry (by ``seq``) that has it."""
    keyed = entries.select(urls.cache_key(F.col("url")).alias("key"), "seq", "dealershipId", "accountID")
    return keyed.groupBy("key").agg(F.min(F.struct("seq", "dealershipId", "accountID")).alias("r")).select("key", "r.dealershipId", "r.accountID")


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _none(requests: DataFrame) -> Column:
    return F.array().cast(dict(requests.dtypes)["items"])


def _rows(requests: DataFrame, *more: str) -> DataFrame:
    """A row for each item of the requests."""
    return requests.select("id", "accountID", "dealershipId", *more, F.posexplode("kept").alias("pos", "item")).select("id", "accountID", "dealershipId", *more, F.col("item.stockId").alias("stockId"), "pos", "item")


def sync_requests(requests: DataFrame, entries: DataFrame) -> Synced:
    """What syncs (id, url, at, dealershipId, accountID, skipUpsert, items) leave.

    Rows with a stock number of either field are cached under the URL. A cache-only sync (``skipUpsert``) owns nothing and flags
    its URL; another is upserted if its owner is known, as it says or as the source entry of its URL does. A URL without
    scheme or host is refused and leaves nothing but its response.
    """
    valid = urls.is_valid(_plain("url"))
    kept = F.filter("items", lambda i: (i["stockId"] != "") | (i["stock"] != ""))
    own = owners(entries).select(F.col("key").alias("_key"), F.col("dealershipId").alias("_d"), F.col("accountID").alias("_a"))
    skip = F.coalesce("skipUpsert", F.lit(False))
    named = requests.withColumns({"_key": urls.cache_key(_plain("url")), "valid": valid, "skip": skip, "kept": F.coalesce(kept, _none(requests))}).join(own, "_key", "left")
    owner = lambda name, known: F.when(F.col("skip"), "").otherwise(F.coalesce(F.nullif(_plain(name), F.lit("")), F.col(known), F.lit("")))
    named = named.withColumns({"dealershipId": owner("dealershipId", "_d"), "accountID": owner("accountID", "_a")})
    taken = named.where("valid")
    upserted = F.col("valid") & ~F.col("skip") & (F.col("accountID") != "") & (F.col("dealershipId") != "") & (F.size("kept") > 0)
    code = F.when(~F.col("valid"), "INVALID_REQUEST").otherwise("")
    return Synced(
        taken.select(F.col("url").alias("source_url"), "dealershipId", "accountID", F.col("at").alias("updated_at"), F.col("kept").alias("items")), taken.where("skip").select(F.col("url").alias("source_url"), F.lit(SYNCED).alias("reason"), F.col("at").alias("flagged_at")),
        _rows(named.where(upserted), "url"), named.select("id", "url", code.alias("code"), F.when(code != "", BAD_URL).otherwise("").alias("message"), "dealershipId", "accountID", F.when(F.col("valid"), F.size("kept")).otherwise(0).alias("cachedItems"), upserted.alias("upserted")),
    )


def upsert_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that upserts (id, accountID, dealershipId, activityTrigger, items) bring, and a response for each.

    A request without owner, or without rows that have a stock number, is refused whole.
    """
    named = requests.withColumns({"accountID": _plain("accountID"), "dealershipId": _plain("dealershipId"), "kept": F.coalesce(F.filter("items", lambda i: i["stockId"] != ""), _none(requests))})
    message = F.when((F.col("accountID") == "") | (F.col("dealershipId") == ""), NO_OWNER).when(F.size("kept") == 0, NO_ROWS).otherwise("")
    named = named.withColumn("message", message)
    good = F.col("message") == ""
    responses = named.select("id", F.when(good, "ok").otherwise("INVALID_REQUEST").alias("status"), "message", F.when(good, F.size("kept")).otherwise(0).alias("count"), trigger(F.col("activityTrigger")).alias("trigger"))
    return _rows(named.where(good)), responses


def apply_syncs(cache: DataFrame, cached: DataFrame) -> DataFrame:
    """The cache with each synced URL's latest row, by cache key."""
    keyed = lambda df: df.withColumn("_key", urls.cache_key(F.col("source_url")))
    return stores.upsert(keyed(cache), keyed(cached), ["_key"], ["updated_at"]).drop("_key")


def with_crawl_limits(templates: DataFrame, pages: int, scrolls: int, clicks: int) -> DataFrame:
    """Templates with the limits of a run: what its options ask for, else their own, else the defaults.

    Columns ``maxPages, scrollMaxAttempts, clickMaxAttempts, maxItems`` and the options ``optPages, optScrolls, optClicks,
    optItems``, which go; a limit counts if it is over zero.
    """
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    of = lambda option, own, default: F.coalesce(positive(option), positive(own), F.lit(default))
    limits = {"maxPages": of("optPages", "maxPages", pages), "scrollMaxAttempts": of("optScrolls", "scrollMaxAttempts", scrolls), "clickMaxAttempts": of("optClicks", "clickMaxAttempts", clicks), "maxItems": F.coalesce(positive("optItems"), F.col("maxItems"))}
    return templates.withColumns(limits).drop("optPages", "optScrolls", "optClicks", "optItems")
