"""The refinements in a listing's URL, checked against what its template allows; errors are values, nothing is ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Parameters without meaning, of a type filter, of the sort and its one value, and the sorts.
IGNORED_PREFIX, IGNORED, TYPE_FILTER, SORT, SORT_VALUE = "utm_", ("gclid", "fbclid"), r"^_dFR\[type\]\[[0-9]+\]$", "idx", "year_high_to_low"
DEFAULT_SORT, OTHER_SORT = "low_price", "year"
NO_TYPES, OTHER_PAGE = "Cars Commerce vehicle types are required", "Cars Commerce template does not match source host/path"


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def parameters(url: Column) -> Column:
    """The query's parameters by name, each with its values in order, as an array of (key, values), and what is wrong with the
    query as a whole: a semicolon, or an escape that is none."""
    parts = F.filter(F.split(F.substring(urls.query(url), 2, 1 << 30), "&"), lambda p: p != "")
    of = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v"), p.alias("raw"))
    pairs = F.transform(parts, of)
    wrong = F.coalesce(F.get(F.filter(F.transform(pairs, lambda p: F.when(p["raw"].contains(";"), F.lit("invalid semicolon separator in query")).when(p["k"].isNull() | p["v"].isNull(), F.concat(F.lit("invalid URL escape "), quoted(F.regexp_extract(p["raw"], "(%(?![0-9a-fA-F]{2}).{0,2})", 1))))), lambda e: e.isNotNull()), F.lit(0)), F.lit(None).cast("string"))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    grouped = F.transform(names, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("values")))
    return F.struct(grouped.alias("parameters"), wrong.alias("error"))


def refinements(sources: DataFrame) -> DataFrame:
    """``sources`` (url, base_url, vehicle_types, vehicle_type) with ``sort``, ``types`` and ``error``.

    Types are those that the URL asks for, once each in the order of its parameters' names, else all of the template's. A
    template without types or with an empty one, another host or path, a repeated parameter, a type that is not the
    template's, another sort and any other parameter are errors, the first by name; then there are no sort and types.
    """
    none = F.array().cast("array<string>")
    allowed = F.when(F.size(F.coalesce("vehicle_types", none)) > 0, F.col("vehicle_types")).when(F.coalesce("vehicle_type", F.lit("")) != "", F.array("vehicle_type")).otherwise(none)
    host, trail = (lambda c: F.lower(urls.authority(F.col(c)))), (lambda c: F.regexp_replace(urls.path(F.col(c)), "/$", ""))
    same = (host("url") == host("base_url")) & (trail("url") == trail("base_url"))
    read = sources.withColumns({"_allowed": allowed, "_q": parameters(F.col("url"))})
    kept = F.filter("_q.parameters", lambda p: ~(p["key"].startswith(IGNORED_PREFIX) | p["key"].isin(*IGNORED)))
    read = read.withColumn("_kept", kept)
    listed = F.concat(F.lit("["), F.array_join(F.transform("_allowed", quoted), " "), F.lit("]"))

    def fault(p: Column) -> Column:
        value = F.get(p["values"], F.lit(0))
        return (
            F.when(F.size(p["values"]) != 1, F.concat(F.lit("unsupported repeated inventory parameter "), quoted(p["key"])))
            .when(p["key"].rlike(TYPE_FILTER), F.when(~F.array_contains("_allowed", value), F.concat(F.lit("inventory type does not match configured "), listed, F.lit(" page"))))
            .when(p["key"] == SORT, F.when(value != SORT_VALUE, F.concat(F.lit("unsupported inventory sort "), quoted(value))))
            .otherwise(F.concat(F.lit("unsupported inventory query parameter "), quoted(p["key"])))
        )

    first = F.get(F.filter(F.transform("_kept", fault), lambda e: e.isNotNull()), F.lit(0))
    error = F.when((F.size("_allowed") == 0) | F.array_contains("_allowed", ""), NO_TYPES).when(~F.coalesce(same, F.lit(False)), OTHER_PAGE).otherwise(F.coalesce("_q.error", first))
    asked = F.array_distinct(F.flatten(F.transform(F.filter("_kept", lambda p: p["key"].rlike(TYPE_FILTER)), lambda p: p["values"])))
    sort = F.when(F.exists("_kept", lambda p: p["key"] == SORT), OTHER_SORT).otherwise(DEFAULT_SORT)
    read = read.withColumn("error", error)
    good = F.col("error").isNull()
    return read.withColumns({"sort": F.when(good, sort), "types": F.when(good, F.when(F.size(asked) > 0, asked).otherwise(F.col("_allowed")))}).drop("_allowed", "_q", "_kept")
