"""Keyed tables: upsert and delete by rewrite, lookups with host fallback, freshness, pending and shrink rules, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import trim

#: Hours that a cached run stays fresh, and that a cached inventory needs no sync (fixed values).
FRESH_HOURS, PENDING_HOURS = 24, 12
#: Share of the last count below which a new count is not believed (fixed value).
SHRINK = 0.6


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key: the greatest by ``version``. A single aggregation with map-side combine, no sort."""
    rest = [c for c in rows.columns if c not in {*keys, *version}]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in rows.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The table with each key's latest row of both."""
    return latest(table.unionByName(changes, allowMissingColumns=True), keys, version)


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def clear_idempotency(runs: DataFrame, keep_prefix: str = "scrape-once-cache|") -> DataFrame:
    """Keys blanked, but those of the scrape-once cache."""
    return runs.withColumn("idempotencyKey", F.when(F.col("idempotencyKey").startswith(keep_prefix), F.col("idempotencyKey")).otherwise(""))


def freshest_by_host(cache: DataFrame, url: str = "source_url", at: str = "updated_at") -> DataFrame:
    return latest(cache.withColumn("host", urls.host_key(F.col(url))), ["host"], [at, url])


def lookup(requests: DataFrame, cache: DataFrame, url: str = "source_url", at: str = "updated_at") -> DataFrame:
    """Each request's cached row: of the exact URL, else the freshest of its host; ``how`` says which, or ``none``."""
    exact = latest(cache.withColumn("key", urls.cache_key(F.col(url))), ["key"], [at, url]).select(F.col("key").alias("_key"), F.col(url).alias("exact_url"))
    host = freshest_by_host(cache, url, at).select(F.col("host").alias("_host"), F.col(url).alias("host_url"))
    asked = requests.withColumns({"key": urls.cache_key(F.col("request_url")), "host": urls.host_key(F.col("request_url"))})
    found = asked.join(exact, asked["key"] == F.col("_key"), "left").join(host, asked["host"] == F.col("_host"), "left")
    how = F.when(F.col("exact_url").isNotNull(), "exact").when(F.col("host_url").isNotNull(), "host").otherwise("none")
    return found.select("request_url", F.coalesce("exact_url", "host_url").alias("cached_url"), how.alias("how"))


def is_fresh(status: Column, items: Column, finished: Column, started: Column, now: Column, hours: int = FRESH_HOURS) -> Column:
    """A successful run with items that ended (else began) within the last hours and not in the future."""
    at = F.coalesce(finished, started)
    return F.coalesce((status == "success") & (items > 0) & (at <= now) & (now < at + F.expr(f"interval {hours} hours")), F.lit(False))


def pending(protected: DataFrame, cache_only: DataFrame, cache: DataFrame, now: Column, hours: int = PENDING_HOURS) -> DataFrame:
    """URLs that need a sync: protected and cache-only ones, each key once (protected first), whose cache is not fresh."""
    named = lambda df, rank: df.select("source_url", F.lit(rank).alias("rank"))
    both = named(protected, 0).unionByName(named(cache_only, 1)).withColumn("key", urls.cache_key(F.col("source_url")))
    once = both.groupBy("key").agg(F.min(F.struct("rank", "source_url")).alias("r")).select("key", "r.source_url")
    held = latest(cache.withColumn("key", urls.cache_key(F.col("source_url"))), ["key"], ["updated_at"]).select(F.col("key").alias("_key"), "updated_at", "items")
    age = ((F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 3600).cast("double")
    joined = once.join(held, once["key"] == F.col("_key"), "left").withColumn("age_hours", age)
    return joined.where(F.col("age_hours").isNull() | (F.col("age_hours") >= hours)).select("key", "source_url", "age_hours", F.coalesce("items", F.lit(0)).alias("items"))


def survives_shrink(new: Column, old: Column) -> Column:
    return (old == 0) | (new >= old * SHRINK)


def matches_schedule(frequency_minutes: Column, label: Column, wanted: str) -> Column:
    """Minutes override the label: a week is weekly, any other positive daily; a blank label counts as daily."""
    low = F.lower(trim(F.coalesce(label, F.lit(""))))
    by_minutes = F.when(frequency_minutes == 10080, "weekly").when(frequency_minutes > 0, "daily")
    return F.coalesce(by_minutes, F.when(low == "", "daily").otherwise(low)) == wanted


def sync_flags(ftp: Column, scrape: Column, sheet: Column, sheet_url: Column) -> tuple[Column, Column, Column]:
    """Null means off, on and off; a spreadsheet also needs its URL."""
    return F.coalesce(ftp, F.lit(False)), F.coalesce(scrape, F.lit(True)), F.coalesce(sheet, F.lit(False)) & (trim(F.coalesce(sheet_url, F.lit(""))) != "")


def scoped_key(raw: Column, dealer: Column, url: Column) -> Column:
    return F.when(trim(raw) == "", "").otherwise(F.concat_ws("|", trim(raw), dealer, urls.source_key(url)))


def once_key(dealer: Column, url: Column) -> Column:
    return F.concat_ws("|", F.lit("scrape-once-cache"), dealer, urls.source_key(url))
