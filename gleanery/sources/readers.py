"""Sources and sinks: landed pages, NDJSON details, source lists, templates, snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import urls

#: A source list entry's fields (fixed values).
ENTRY = "accountID string, dealershipId string, url string, ftp_sync boolean, scrape_sync boolean, spreadsheet_sync boolean, scrapeFrequencyMinutes int, spreadsheetUrl string, inventorySyncFrequencyMinutes int, schedule struct<type:string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages (parquet) under the page schema."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """``url, html`` from NDJSON lines, or from an envelope whose ``results`` maps URLs to pages; broken lines go."""
    raw = spark.read.schema("url string, html string, results map<string,string>").json(path)
    lines = raw.where("url is not null and html is not null").select("url", "html")
    return lines.unionByName(raw.where("results is not null").select(F.explode("results").alias("url", "html")))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source entries from ``{"data": [...]}`` or ``{"data": {"items": [...]}}``."""
    text = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", f"data array<struct<{ENTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' struct', ':struct')}>>")["data"]
    inner = F.from_json("value", f"data struct<items:array<struct<{ENTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' struct', ':struct')}>>>")["data"]["items"]
    return text.select(F.inline(F.coalesce(plain, inner)))


def read_templates(spark: SparkSession, path: str) -> dict[str, dict]:
    """Templates (JSON, one file a site key) by key; files that are not valid are skipped. A few hundred small files."""
    out = {}
    for row in spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value").collect():
        try:
            site = json.loads(row["value"])
        except ValueError:
            continue
        if isinstance(site, dict) and site.get("cardSelector"):
            out[row["f"].rsplit("/", 1)[-1].removesuffix(".json")] = site
    return out


#: What a template must have, and what it gets where it states nothing (fixed values).
NO_CARDS, SCROLLS, CLICKS = "invalid site config: missing cardSelector", 8, 20


def template_of(body: str) -> tuple[str | None, str | None]:
    """A YAML template as JSON with its defaults, or why it is none."""
    try:
        import yaml
    except ImportError as e:  # reading YAML is the one use of it
        raise ImportError("reading templates needs PyYAML on the workers") from e
    try:
        site = yaml.safe_load(body)
    except yaml.YAMLError as e:
        return None, f"invalid YAML: {getattr(e, 'problem', None) or 'not readable'}"
    if not isinstance(site, dict):
        return None, NO_CARDS if site is None else "invalid YAML: no mapping"
    page = site.get("listPage") or {}
    if not isinstance(page, dict):
        return None, "invalid YAML: listPage is no mapping"
    if not page.get("cardSelector") and not site.get("carsCommerce"):
        return None, NO_CARDS
    paging = page.get("pagination") or {}
    page["pagination"] = paging | {"scrollMaxAttempts": paging.get("scrollMaxAttempts") or SCROLLS, "clickMaxAttempts": paging.get("clickMaxAttempts") or CLICKS}
    site["listPage"] = page
    return json.dumps(site, default=str), None


def template_files(spark: SparkSession, path: str) -> DataFrame:
    """``key, name, template, error``: a row for each YAML file (.yaml, .yml) of a folder in any store that Spark reads.

    The key is decoded from the file's name, the name is the template's own, else the key; ``template`` is its JSON with
    defaults; a file that is no template has an error and no template;
    files without a byte, which Spark does not read, have no row. Of two files of a key the .yaml one counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [template_of(v) for v in rows["value"]]
            yield rows[["file"]].assign(template=[f[0] for f in found], error=[f[1] for f in found])

    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("content").cast("string").alias("value"))
    parsed = raw.where(F.col("file").rlike(r"\.ya?ml$")).mapInPandas(run, "file string, template string, error string")
    key = urls.template_key_of_file(F.regexp_replace(F.col("file"), r"\.ya?ml$", ""))
    first = parsed.withColumn("key", key).groupBy("key").agg(F.max(F.struct(F.col("file").endswith(".yaml").alias("y"), "template", "error")).alias("r"))
    name = F.coalesce(F.nullif(F.get_json_object("r.template", "$.name"), F.lit("")), "key")
    return first.select("key", F.when(F.col("r.error").isNull(), name).alias("name"), "r.template", "r.error")


def resolve_templates(sources: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sources with their template's name, and an error row for each source without one."""
    named = sources.withColumn("template", urls.template_file(urls.template_key(F.col("url"))))
    has = F.col("template").isin(known) if known else F.lit(False)
    errors = named.where(~has).select(F.col("url").alias("itemUrl"), F.lit("SITE_CONFIG_NOT_FOUND").alias("code"), F.concat(F.lit("no template "), "template").alias("message"))
    return named.where(has), errors


def write_snapshot(items: DataFrame, path: str) -> None:
    """JSON lines."""
    items.write.mode("overwrite").json(path)
