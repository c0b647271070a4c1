"""WARC not-modified revisits, resolved to the full response that they stand for.

A revisit (a 304 capture) has no payload. It takes the payload and headers of the latest earlier full response of its
canonical URL, if its validators agree, and its own headers replace those that a 304 may update.

The as-of join needs no single task for a busy URL: the latest response of each second is an aggregation with map-side
combine; seconds fall into time slices, a running maximum over the small slice table carries responses forward, and only the
seconds of one slice of one URL, as many as the slice has at most, are ordered against each other. Captures, however many a
second has, are joined with what their second sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .url_trust import host_of, path_of

#: Header fields that describe the stored payload or the connection; a 304 doesn't update them (fixed values).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without its last slash, query kept; scheme and fragment go."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host, F.regexp_replace(path_of(url), "/$", ""), query))


def field(headers: Column, name: str) -> Column:
    """The first value of a header field, else null."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def normal_headers(headers: Column) -> Column:
    """Header entries with lower-case names, trimmed values, in order of name and value; null counts as none."""
    entries = F.transform(headers, lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), F.trim(h["value"]).alias("value")))
    return F.array_sort(F.coalesce(F.filter(entries, lambda h: h["name"].isNotNull()), F.array().cast("array<struct<name:string,value:string>>")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, those that a 304 may update replaced by the revisit's."""
    allowed = F.filter(fresh, lambda h: ~h["name"].isin(*KEPT_FIELDS))
    names = F.transform(allowed, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), allowed))


def resolve_revisits(records: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Every record of ``record_id, url, at, kind, status, headers, digest`` with its resolution.

    ``at`` is in whole seconds; ``kind`` is response or revisit; ``headers`` is array<struct<name, value>>. A full
    response is a response of status 200. Returned: ``record_id, url_key, at, kind, outcome, source_record_id,
    source_at, status, headers, digest``. Outcomes: ``full``, ``other`` (neither a full response nor a revisit), and for
    revisits ``resolved``, ``no_earlier_response``, ``validator_mismatch``, ``no_validator`` or ``invalid`` (null url,
    url without host, or null time). Unresolved records keep their own status, headers and digest.

    Validators are looked at in this order: ETag (weak comparison), Last-Modified, payload digest; the first that the
    revisit has decides. Of responses at the same second the greatest record_id counts; a response at a revisit's own
    second isn't earlier. Repeated rows are each returned. Other columns are ignored; an empty table gives none.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long").alias("at"), "kind", "status", normal_headers(F.col("headers")).alias("headers"), "digest")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    valid = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    stored = F.when(F.coalesce(full & valid, F.lit(False)), F.struct("at", "record_id", "headers", "digest"))
    rows = rows.withColumn("slice", F.floor(F.col("at") / slice_seconds)).withColumn("stored", stored)
    timed, untimed = rows.where(valid), rows.where(~valid)

    seconds = timed.groupBy("url_key", "slice", "at").agg(F.max("stored").alias("latest"))
    slices = seconds.groupBy("url_key", "slice").agg(F.max("latest").alias("latest"))
    before = lambda *by: Window.partitionBy("url_key", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("url_key", "slice", F.max("latest").over(before("slice")).alias("carried"))
    near = seconds.withColumn("near", F.max("latest").over(before("slice", "at")))
    seen = near.join(carried, ["url_key", "slice"]).select("url_key", "at", F.coalesce("near", "carried").alias("found"))
    found = timed.join(seen, ["url_key", "at"])
    every = found.unionByName(untimed.withColumn("found", F.lit(None).cast(found.schema["found"].dataType)))

    tag, since = field(F.col("headers"), "etag"), field(F.col("headers"), "last-modified")
    same_tag = F.regexp_replace(tag, "^W/", "") == F.regexp_replace(field(F.col("found.headers"), "etag"), "^W/", "")
    same = F.when(tag.isNotNull(), same_tag).when(since.isNotNull(), since == field(F.col("found.headers"), "last-modified")).when(F.col("digest").isNotNull(), F.col("digest") == F.col("found.digest"))
    revisit = F.when(~valid, "invalid").when(F.col("found").isNull(), "no_earlier_response").when(tag.isNull() & since.isNull() & F.col("digest").isNull(), "no_validator").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("validator_mismatch")
    every = every.withColumn("outcome", F.when(F.col("kind") == "revisit", revisit).when(F.coalesce(full, F.lit(False)), "full").otherwise("other"))
    done = F.col("outcome") == "resolved"
    pick = lambda new, own: F.when(done, new).otherwise(F.col(own)).alias(own)
    return every.select("record_id", "url_key", "at", "kind", "outcome", F.when(done, F.col("found.record_id")).alias("source_record_id"), F.when(done, F.col("found.at")).alias("source_at"), pick(F.lit(200), "status"), pick(merged_headers(F.col("found.headers"), F.col("headers")), "headers"), pick(F.col("found.digest"), "digest"))


def with_payloads(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Adds ``payload`` from ``payloads(record_id, payload)``: a full response's own, a resolved revisit's source's."""
    held = payloads.select(F.col("record_id").alias("held_id"), "payload")
    return resolved.join(held, F.coalesce("source_record_id", F.when(F.col("outcome") == "full", F.col("record_id"))) == F.col("held_id"), "left").drop("held_id")
