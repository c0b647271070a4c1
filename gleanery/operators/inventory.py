"""Listing validity, identity counts, run status, error rows, detail selection, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text, urls

# The words that score a link, stages whose counts are stable, and what errors mean.
DETAIL_PATHS = ("/pre-owned-cars/detail/", "/vehicle-details/", "/inventory/", "/viewdetails/")
SIDE_WORDS = ("compare", "schedule", "finance", "service")
DEAD_PREFIXES = ("javascript:", "mailto:", "tel:")
MAP_LINKS = ("google.com/maps", "api=1&destination=")
BLOCK_CODES = ("SCRAPE_RENDER_FAILED", "PAGINATION_FETCH_FAILED")
BLOCK_WORDS = ("datadome", "captcha-delivery", "blocked", "all strategies failed")
TIMEOUT_WORDS = ("deadline exceeded", "client.timeout", "timeout", "temporary", "connection reset", "eof")
NEEDED = ("title", "url", "vin", "stockId", "price", "mileage", "primaryImage")
DESCRIPTIVE = ("title", "price", "mileage", "primaryImage", "year", "make", "model")


def _any_starts(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(w) for w in words])


def listing_score(url: Column) -> Column:
    """How much a link looks like a vehicle's page; -100 for what cannot be one."""
    low = F.lower(text.trim(url))
    dead = (low == "") | _any_starts(low, DEAD_PREFIXES) | (low == "#") | identity.contains_any(low, MAP_LINKS)
    term = lambda hit, points: F.when(hit, points).otherwise(0)
    total = term(identity.contains_any(low, DETAIL_PATHS), 10) + term(low.startswith("/"), 2) + term(urls.authority(low).contains("google."), -10) + term(identity.contains_any(low, SIDE_WORDS), -3)
    return F.when(dead, -100).otherwise(total)


def is_useful_listing(c=F.col) -> Column:
    """Whether a card is a vehicle: by its link's score and how many signals it has."""
    signals = reduce(lambda a, b: a + b, [(c(n) != "").cast("int") for n in ("title", "stockId", "price", "mileage", "primaryImage", "vin")])
    score = listing_score(c("url"))
    return (score >= 8) | ((score >= 3) & (signals >= 2)) | ((c("stockId") != "") & (signals >= 2)) | ((c("title") != "") & ((c("price") != "") | (c("primaryImage") != "")))


def is_credible(c=F.col) -> Column:
    """A valid vehicle number, or a stock number with a URL or a description, or a URL with a description."""
    has_url = text.trim(c("url")) != ""
    described = reduce(lambda a, b: a | b, [text.trim(c(n)) != "" for n in DESCRIPTIVE])
    return (identity.valid_vin(c("vin")) != "") | (~identity.is_missing_stock(identity.stock_number(c("stockId"))) & (has_url | described)) | (has_url & described)


def is_complete(c=F.col) -> Column:
    """Whether a detail page would add nothing."""
    return reduce(lambda a, b: a & b, [text.trim(c(n)) != "" for n in NEEDED])


def invalid_errors(items: DataFrame, by: list[str]) -> DataFrame:
    """One ``INVALID_ITEMS_FILTERED`` row for each run that has rows which are not credible."""
    return items.where(~is_credible()).groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit("INVALID_ITEMS_FILTERED").alias("code"), F.concat(F.lit("filtered "), F.col("n").cast("string"), F.lit(" invalid items")).alias("message"))


def vin_key(c=F.col) -> Column:
    return F.nullif(F.upper(text.trim(c("vin"))), F.lit(""))


def stock_key(c=F.col) -> Column:
    own = F.upper(text.trim(c("stockId")))
    return F.nullif(F.when(own == "", F.upper(text.trim(c("stock")))).otherwise(own), F.lit(""))


def inventory_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """Distinct vehicle numbers, stock numbers and identities; the inventory is the identities, else the rows.

    An identity is a vehicle number, or the stock number of a row without one. Every row is two keys, which are combined
    before they are shuffled.
    """
    keys = F.explode(F.array(F.struct(F.lit("vin").alias("kind"), vin_key().alias("key")), F.struct(F.lit("stock").alias("kind"), stock_key().alias("key"))))
    each = items.select(*by, vin_key().isNull().alias("alone"), keys.alias("k")).groupBy(*by, "k").agg(F.max("alone").alias("alone"), F.count("*").alias("n"))
    of = lambda kind, rule=None: F.count_if((F.col("k.kind") == kind) & F.col("k.key").isNotNull() & (rule if rule is not None else F.lit(True)))
    counted = each.groupBy(*by).agg(of("vin").alias("unique_vins"), of("stock").alias("unique_stocks"), (of("vin") + of("stock", F.col("alone"))).alias("identities"), F.sum(F.when(F.col("k.kind") == "vin", F.col("n"))).alias("n"))
    return counted.select(*by, "unique_vins", "unique_stocks", "identities", F.when(F.col("identities") > 0, F.col("identities")).otherwise(F.col("n")).alias("inventory"))


def details_needed(items: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Distinct URLs of incomplete rows in first-seen order, ``limit`` a run, with the number of URLs cut."""
    first = items.where(~is_complete() & (text.trim(F.col("url")) != "")).groupBy(*by, "url").agg(F.min("seq").alias("seq"))
    order, whole = Window.partitionBy(*by).orderBy("seq"), Window.partitionBy(*by)
    ranked = first.withColumns({"place": F.row_number().over(order), "cut": F.greatest(F.count("*").over(whole) - limit, F.lit(0))})
    return ranked.where(F.col("place") <= limit).select(*by, "url", "place", "cut")


def run_status(items: Column, errors: Column) -> Column:
    """No items: failed; items and errors: partial_success; else success."""
    return F.when(items == 0, "failed").when(errors > 0, "partial_success").otherwise("success")


def run_errors(errors: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Error rows of runs: ``FALLBACK_EMPTY`` goes where items were found, ``NO_ITEMS`` comes where none were."""
    have = counts.select(*[F.col(b).alias(f"_{b}") for b in by], "items")
    on = reduce(lambda x, y: x & y, [errors[b] == have[f"_{b}"] for b in by])
    kept = errors.join(have, on, "left").where(~((F.col("code") == "FALLBACK_EMPTY") & (F.coalesce("items", F.lit(0)) > 0))).select(*by, "code", "message")
    return kept.unionByName(counts.where("items = 0").select(*by, F.lit("NO_ITEMS").alias("code"), F.lit("no items found").alias("message")))


def is_block_error(code: Column, message: Column) -> Column:
    return code.isin(*BLOCK_CODES) & identity.contains_any(F.lower(message), BLOCK_WORDS)


def is_timeout_error(message: Column) -> Column:
    return identity.contains_any(F.lower(message), TIMEOUT_WORDS)


def least_positive(*limits: Column) -> Column:
    """The smallest of the limits over zero; 0 (no limit) if none is."""
    return F.coalesce(F.least(*[F.when(x > 0, x) for x in limits]) if len(limits) > 1 else F.when(limits[0] > 0, limits[0]), F.lit(0))


def capped(items: DataFrame, by: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each run in order of ``seq``."""
    return items.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("_place") <= cap).drop("_place")


def strict_snapshot(rows: DataFrame, by: list[str], vin: str, stock: str, total: str) -> DataFrame:
    """All rows of the runs whose numbers are unique and present and whose stated totals agree with their rows."""
    checks = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.countDistinct(vin).alias("_v"), F.countDistinct(stock).alias("_s"), F.min(total).alias("_lo"), F.max(total).alias("_hi"))
    good = checks.where("_n = _v and _n = _s and _lo = _hi and _lo = _n").select(*by)
    return rows.join(good, by, "left_semi")


def inner_or_fail(listings: DataFrame, posts: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Listings joined to posts of the runs where every listing has one, and the unmatched listings."""
    unmatched = listings.join(posts, key, "left_anti")
    return listings.join(unmatched.select(*by).distinct(), by, "left_anti").join(posts, key), unmatched
