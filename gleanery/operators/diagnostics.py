"""Page diagnostics, block predicates, the bounded event log, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# What blocked pages say, in order, and the bounds of the log.
BLOCK_MARKERS = ("sorry, you have been blocked", "cf-chl-", "captcha-delivery.com", "access denied", "just a moment", "verify you are human")
CHALLENGE_HOST, CHALLENGE_BOOT, CHALLENGE_BYTES = "captcha-delivery.com", "datadome", 4000
FIRST_EVENTS, LAST_EVENTS = 16, 144


def block_marker(html: Column) -> Column:
    low, out = F.lower(html), F.lit("")
    for m in reversed(BLOCK_MARKERS):
        out = F.when(low.contains(m), m).otherwise(out)
    return out


def title(html: Column) -> Column:
    """Between the first opening tag and the next closing one: if the first has none, no later one has, and none is tried."""
    return text.trim(F.regexp_extract(html, r"(?is)\A(?>.*?<title[^>]*)>(.*?)</title>", 1))


def page_diagnostics(pages: DataFrame) -> DataFrame:
    """Bytes, digest, title (redacted, 200 bytes) and the first block marker of every page."""
    html = F.col("html")
    return pages.select("page_id", F.octet_length(html).alias("bytes"), F.sha2(html, 256).alias("body_sha256"), text.byte_prefix(text.redact(title(html)), 200).alias("title"), block_marker(html).alias("block_marker"))


def is_challenge(html: Column) -> Column:
    low = F.lower(html)
    return low.contains(CHALLENGE_HOST) | ((F.octet_length(html) < CHALLENGE_BYTES) & low.contains(CHALLENGE_BOOT))


def bounded_events(events: DataFrame, by: list[str], order: list[str], first: int = FIRST_EVENTS, last: int = LAST_EVENTS) -> DataFrame:
    """The first and the latest events of each log in order, and how many between them were dropped."""
    up, down, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]), Window.partitionBy(*by)
    ranked = events.withColumns({"place": F.row_number().over(up), "_back": F.row_number().over(down), "dropped": F.greatest(F.count("*").over(whole) - (first + last), F.lit(0))})
    return ranked.where((F.col("place") <= first) | (F.col("_back") <= last)).drop("_back")


def bounded_tail(output: Column, limit: int = 16384) -> Column:
    """The last bytes of a stream; where it was cut, a note stands for the broken first line."""
    tail = text.byte_suffix(output, limit)
    rest = F.regexp_extract(tail, "(?s)^[^\n]*\n(.*)$", 1)
    return F.when(F.octet_length(output) <= limit, output).otherwise(F.concat(F.lit("[earlier stderr truncated]\n"), rest))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Runs, items and seconds by status."""
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.sum("items").alias("items"), F.sum("seconds").alias("seconds"))
