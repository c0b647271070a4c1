"""A scheduled job over source entries: which are due, what each run yields, and the rows that are imported.

An entry is ``accountID, dealershipId, url`` and its flags and schedule; a run is ``url, at, config_error, items, errors``, items being the
array that the run's row holds; a cached inventory is ``source_url, updated_at, items``. Every entry is one row throughout: its
run, flag and cache are joined, and the outcome is an expression over them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from . import inventory, stores
from .steps import step

# The messages of outcomes, and the bytes that an activity carries.
NO_CACHE, EMPTY_CACHE, NO_ITEMS, NO_STOCK = "Cache-only source has no cached inventory", "Cached inventory is empty", "No inventory items returned", "No rows with stock IDs to import"
USED, USED_AFTER, CONFIG, FLAGGED = "Used cached inventory from ", "Live scrape failed; used cached inventory from ", "Site configuration failed: ", "bot-blocked in scheduled job"
UNFINISHED = "Scrape did not complete"
MESSAGE_BYTES, SOURCE_BYTES, TRIGGERS = 2000, 4000, ("manual", "scheduled", "signup")


class Outcome(NamedTuple):
    """Tables by name: imported ``inventory`` rows, ``results``, ``activity`` events, newly flagged URLs."""

    inventory: DataFrame
    results: DataFrame
    activity: DataFrame
    flagged: DataFrame


def trigger(value: Column) -> Column:
    """A known trigger, else ``service``."""
    return F.when(value.isin(*TRIGGERS), value).otherwise("service")


def due(entries: DataFrame, schedule: str) -> DataFrame:
    """Entries that are to be scraped on a schedule: it is theirs, scraping is on, and they name a dealership and a URL."""
    _, scrape, _ = stores.sync_flags(F.col("ftp_sync"), F.col("scrape_sync"), F.col("spreadsheet_sync"), F.col("spreadsheetUrl"))
    named = (F.coalesce("dealershipId", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    return entries.where(stores.matches_schedule(F.col("scrapeFrequencyMinutes"), F.col("schedule.type"), schedule) & scrape & named)


def source_syncs(entries: DataFrame, schedule: str) -> DataFrame:
    """``accountID, kind``: accounts whose files (of due entries) and, daily, spreadsheets (of all entries) are synced."""
    ftp, _, sheet = stores.sync_flags(F.col("ftp_sync"), F.col("scrape_sync"), F.col("spreadsheet_sync"), F.col("spreadsheetUrl"))
    account = text.trim(F.coalesce("accountID", F.lit("")))
    files = entries.where(stores.matches_schedule(F.col("scrapeFrequencyMinutes"), F.col("schedule.type"), schedule) & ftp).select(account.alias("accountID"), F.lit("files").alias("kind"))
    sheets = entries.where(sheet & F.lit(schedule == "daily")).select(account.alias("accountID"), F.lit("spreadsheet").alias("kind"))
    return files.unionByName(sheets).where("accountID <> ''")


def _distinct(keys: Column) -> Column:
    return F.size(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def item_count(items: Column) -> Column:
    """The distinct identities of an array of items, else its size."""
    of = lambda i: lambda name: i[name]
    keys = F.transform(items, lambda i: F.coalesce(F.concat(F.lit("vin:"), inventory.vin_key(of(i))), F.concat(F.lit("stock:"), inventory.stock_key(of(i)))))
    return F.when(_distinct(keys) > 0, _distinct(keys)).otherwise(F.size(items)).cast("long")


def outcomes(entries: DataFrame, runs: DataFrame, cache: DataFrame, flagged: DataFrame, cache_only: DataFrame, job: str, schedule: str) -> Outcome:
    """What a job leaves of the due entries.

    Cache-only and flagged URLs are served from the cache. Others are as their run: without items it failed, with errors
    it is a partial success, and its first error is the message; a run that only met a block flags its URL and falls back to
    the cache. Without a run, a template or a needed cache there is a failed result and nothing to import. Otherwise the
    rows with a stock number are imported, and if there are none, an event says that the import was skipped.

    Ids are hashes of job, dealership and URL, so a job that is done again yields the same rows. ``flagged`` and
    ``cache_only`` are (source_url); URLs are compared by their cache keys, cached inventories by URL, else by host.
    """
    key = lambda c: urls.cache_key(F.col(c))
    ready = due(entries, schedule).select("accountID", "dealershipId", "url", key("url").alias("key"), F.sha2(F.concat_ws("|", F.lit(job), "dealershipId", "url"), 256).alias("id"))
    ready = ready.dropDuplicates(["id", "accountID"])
    from_cache = flagged.select(key("source_url").alias("key")).unionByName(cache_only.select(key("source_url").alias("key"))).distinct().withColumn("use_cache", F.lit(True))
    found = stores.lookup(ready.select(F.col("url").alias("request_url")).distinct(), cache.select("source_url", "updated_at")).select(F.col("request_url").alias("url"), F.col("cached_url").alias("source_url"))
    held = stores.latest(cache.select("source_url", "updated_at", F.col("items").alias("cached_items")), ["source_url"], ["updated_at"])
    latest = stores.latest(runs.select("url", "at", "config_error", F.col("items").alias("run_items"), "errors"), ["url"], ["at"])
    row = ready.join(from_cache, "key", "left").join(latest, "url", "left").join(found.join(held, "source_url"), "url", "left")

    none, no_errors = F.array().cast(dict(runs.dtypes)["items"]), F.array().cast(dict(runs.dtypes)["errors"])
    errors = F.coalesce("errors", no_errors)
    first, cached_at = F.coalesce(F.get(errors, F.lit(0))["message"], F.lit("")), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    empty = F.size(F.coalesce("run_items", none)) == 0
    blocked = empty & F.exists(errors, lambda e: inventory.is_block_error(e["code"], e["message"]))
    has_cache, use_cache = F.col("updated_at").isNotNull(), F.coalesce("use_cache", F.lit(False))
    run_message = F.when(first != "", first).when(empty, NO_ITEMS).otherwise("")
    way = (
        F.when(use_cache, F.when(has_cache, "cache").otherwise("no_cache")).when(F.col("at").isNull(), "no_run").when(F.coalesce("config_error", F.lit("")) != "", "no_config")
        .when(blocked, F.when(has_cache, "fallback").otherwise("blocked")).otherwise("run")
    )
    row = step(row.withColumns({"way": way, "blocked": ~use_cache & F.col("at").isNotNull() & (F.coalesce("config_error", F.lit("")) == "") & blocked, "run_message": run_message}), "scheduled")
    cached = F.col("way").isin("cache", "fallback")
    items = F.when(cached, F.col("cached_items")).when(F.col("way") == "run", F.col("run_items"))
    row = step(row.withColumns({"got": F.coalesce(items, none), "kept_errors": F.when(F.col("way") == "run", errors).otherwise(no_errors)}), "scheduled-items").withColumn("n", item_count(F.col("got")))
    failed = F.col("way").isin("no_cache", "no_run", "no_config", "blocked")
    status = F.when(failed | (F.size("got") == 0) | (F.col("n") == 0), "failed").when(cached, "cached").when(F.size("kept_errors") > 0, "partial_success").otherwise("success")
    message = (
        F.when(F.col("way") == "no_cache", NO_CACHE).when(F.col("way") == "no_run", UNFINISHED).when(F.col("way") == "no_config", F.concat(F.lit(CONFIG), "config_error")).when(cached & (F.col("n") == 0), EMPTY_CACHE)
        .when(F.col("way") == "cache", F.concat(F.lit(USED), cached_at)).when(F.col("way") == "fallback", F.concat(F.lit(USED_AFTER), cached_at, F.lit(": "), "run_message")).otherwise(F.col("run_message"))
    )
    row = row.withColumns({"status": status, "message": message})
    event = lambda df, phase, status, n, message: df.select(F.sha2(F.concat_ws("|", F.lit(phase), "id", "accountID"), 256).alias("id"), "dealershipId", "accountID", F.lit(phase).alias("phase"), F.lit("scheduled").alias("trigger"), status.alias("status"), text.byte_prefix(F.col("url"), SOURCE_BYTES).alias("sourceUrl"), n.cast("long").alias("itemCount"), text.byte_prefix(message, MESSAGE_BYTES).alias("message"))
    stocked = F.filter("got", lambda i: i["stockId"] != "")
    done = row.where(~failed).withColumn("stocked", stocked)
    imported, skipped = done.where(F.size("stocked") > 0), done.where(F.size("stocked") == 0)
    activity = event(row, "scrape", F.col("status"), F.when(failed, 0).otherwise(F.col("n")), F.col("message"))
    activity = activity.unionByName(event(imported, "import", F.lit("success"), F.size("stocked"), F.lit(""))).unionByName(event(skipped, "import", F.lit("skipped"), F.lit(0), F.lit(NO_STOCK)))
    result_status = F.when(failed, "failed").when(F.size("kept_errors") > 0, "partial_success").otherwise("success")
    results = row.select(F.col("id").alias("resultId"), "dealershipId", F.col("url").alias("sourceUrl"), result_status.alias("status"), F.when(failed, 0).otherwise(F.col("n")).cast("long").alias("totalItems"), F.size("kept_errors").alias("errorCount"), F.when(failed, F.col("message")).otherwise("").alias("failureReason")).dropDuplicates(["resultId"])
    rows = imported.select("accountID", "dealershipId", F.col("url").alias("sourceUrl"), F.posexplode("stocked").alias("pos", "item")).select("accountID", "dealershipId", F.col("item.stockId").alias("stockId"), "sourceUrl", "pos", "item")
    new_flags = row.where("blocked").select(F.col("url").alias("source_url"), F.lit(FLAGGED).alias("reason")).distinct()
    return Outcome(rows, results, activity, new_flags)


#: Keys of the sink's tables, and what orders the rows of a key within a batch.
KEYS = {"inventory": (["accountID", "dealershipId", "stockId"], ["sourceUrl", "pos"]), "results": (["resultId"], []), "activity": (["id"], []), "flagged": (["source_url"], [])}


def write_batch(outcome: Outcome, base: str, batch: int) -> None:
    """Writes all tables of a batch under its number, and then that the batch is there.

    A batch that is written again replaces what it wrote, and a batch that was cut off shows nothing of itself: readers take
    only batches whose mark was written, so rows, results and activity appear together.
    """
    spark = outcome.results.sparkSession
    for name, rows in outcome._asdict().items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
    spark.range(1).select(F.lit(batch).cast("long").alias("number")).write.mode("overwrite").parquet(f"{base}/marks/batch={batch}")


def view(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the sink: each key's row of the latest whole batch."""
    keys, order = KEYS[name]
    rows = spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
    whole = spark.read.option("basePath", f"{base}/marks").parquet(f"{base}/marks").select("batch").distinct()
    return stores.latest(rows.join(whole, "batch", "left_semi"), keys, ["batch", *order]).drop("batch")
