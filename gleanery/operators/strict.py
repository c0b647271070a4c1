"""Listings that are taken whole or not at all: pages of one source must agree, numbers must be unique and valid.

Numbers keep their spelling in the payload, which Spark's JSON reader would change, so payloads are parsed in batches
by a small Python function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as tree
from ..functions import identity, text, urls
from .steps import map_pages, written

# Item fields by their place in a listing.
PLACES = {
    "vin": "vin", "stockId": "stock", "year": "year", "make": "make", "model": "model", "style": "trim", "url": "vdp_url", "mileage": "mileage", "color": "styles.exterior_color", "engine": "mechanical.engine",
    "transmission": "mechanical.transmission", "transmissionType": "mechanical.transmission_type", "driveType": "mechanical.drivetrain", "fuelType": "mechanical.fuel_type", "cylinders": "mechanical.engine_cylinders",
    "horsepower": "mechanical.horsepower", "torque": "mechanical.torque", "fuelCapacity": "mechanical.fuel_tank_capacity", "cityMPG": "mechanical.city_mpg", "highwayMPG": "mechanical.highway_mpg",
    "passengerCapacity": "passenger_capacity", "bodyType": "body_details.type", "title": "extra_fields.title",
}
LOW_PRICE, OWN_PRICE = "extra_fields.lightning.pricing.low.value", "pricing.our_price"


def at(obj, place: str):
    for name in place.split("."):
        obj = obj.get(name) if isinstance(obj, dict) else None
    return obj


def scalar(value) -> str:
    """A JSON scalar as text; null, objects and lists are ''."""
    return value if isinstance(value, str) else "" if value is None or isinstance(value, (dict, list)) else json.dumps(value)


def listing(obj: dict) -> dict:
    item = {field: scalar(at(obj, place)) for field, place in PLACES.items()}
    low = at(obj, LOW_PRICE)
    item["price"] = scalar(low if low is not None else at(obj, OWN_PRICE))
    item["title"] = item["title"] or " ".join(v for v in (scalar(obj.get("type")), item["year"], item["make"], item["model"], item["style"]) if v)
    images = [i for i in at(obj, "media.images") or [] if isinstance(i, str)]
    return item | {"images": images, "primaryImage": images[0] if images else ""}


def listings(payloads: DataFrame) -> DataFrame:
    """``run_id, page_seq, pos, page, pages, total`` and item fields of payloads ``{page, total_pages, total, listings}``."""
    fields = [*PLACES, "price", "primaryImage"]
    schema = "run_id string, page_seq int, pos int, page string, pages string, total string, " + ", ".join(f"{f} string" for f in fields) + ", images array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for run_id, seq, body in zip(rows["run_id"], rows["page_seq"], rows["payload"], strict=True):
                try:
                    page = json.loads(body, parse_int=str, parse_float=str)
                except (TypeError, ValueError):
                    page = {}
                for pos, obj in enumerate(page.get("listings") or [] if isinstance(page, dict) else []):
                    item = listing(obj)
                    out.append((run_id, seq, pos, scalar(page.get("page")), scalar(page.get("total_pages")), scalar(page.get("total")), *(item[f] for f in fields), item["images"]))
            yield pd.DataFrame(out, columns=["run_id", "page_seq", "pos", "page", "pages", "total", *fields, "images"])

    return map_pages(payloads.select("run_id", "page_seq", "payload"), run, schema)


def all_or_nothing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of runs that hold together, and a ``CARS_COMMERCE_FETCH_FAILED`` error for each run that doesn't.

    A run holds together if its pages state one total and one page count, as many rows and pages came, and every row
    has a valid vehicle number and a stock number of its own.
    """
    checks = rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.countDistinct(F.nullif(identity.valid_vin(F.col("vin")), F.lit(""))).alias("vins"), F.countDistinct(F.nullif(F.upper(text.trim(F.col("stockId"))), F.lit(""))).alias("stocks"),
        F.min("total").alias("total"), F.max("total").alias("most"), F.min("pages").alias("pages"), F.max("pages").alias("most_pages"), F.countDistinct("page").alias("came"),
    )
    whole = (F.col("n") == F.col("vins")) & (F.col("n") == F.col("stocks")) & (F.col("total") == F.col("most")) & (F.col("pages") == F.col("most_pages")) & (F.col("total").try_cast("long") == F.col("n")) & (F.col("pages").try_cast("long") == F.col("came"))
    good = checks.where(F.coalesce(whole, F.lit(False))).select("run_id")
    failed = checks.where(~F.coalesce(whole, F.lit(False))).select("run_id", F.lit("CARS_COMMERCE_FETCH_FAILED").alias("code"), F.lit("pages or vehicles do not agree").alias("message"))
    return rows.join(good, "run_id", "left_semi"), failed


def joined_posts(listing_rows: DataFrame, posts: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings (run_id, id, vin) with their posts (id, vin, stock) and ordered galleries (parent, rank, url).

    A run with a listing that has no post, a post of another number, or a stock equal to its number is left out; its
    run_id is returned as the second table.
    """
    held = posts.select(F.col("id").alias("_id"), F.upper(text.trim(F.col("vin"))).alias("_vin"), "stock")
    both = listing_rows.join(held, listing_rows["id"] == F.col("_id"), "left")
    right = (F.upper(text.trim(F.col("vin"))) == F.col("_vin")) & (text.trim(F.col("stock")) != "") & (F.upper(text.trim(F.col("stock"))) != F.col("_vin"))
    failed = both.where(~F.coalesce(right, F.lit(False))).select("run_id").distinct()
    gallery = media.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda m: m["url"]).alias("images"))
    good = both.join(failed, "run_id", "left_anti").join(gallery, F.col("id") == F.col("parent"), "left")
    return good.select("run_id", "id", "vin", "stock", F.coalesce("images", F.array().cast("array<string>")).alias("images")), failed


# What a listing page states of its set, and the rules' messages.
STATUS_SELECT, STATUS_KEPT, SET_PAGER, SET_TOTAL, MOST_SET_PAGES = "select[name='SoldStatus']", "AvailableVehicles", "[class*='pagination']", "input.data-inventory-total-records", 1000
SET_PAGE = r"(?i)page\s+([0-9]+)\s+of\s+([0-9]+)"
NO_FILTER = "site did not retain the Available status filter; refusing to sync unfiltered inventory"
NO_PAGER, BAD_PAGER, BAD_TOTAL = "missing 'Page X of Y' pagination; refusing to guess completeness", "invalid pagination counts", "invalid inventory total"
CHANGED = "inventory totals changed during scraping; rerun to get a consistent inventory"


def available_page_url(source: Column, page: Column) -> Column:
    """The URL of a page of the filtered listing."""
    return F.concat(source, F.lit(f"?SoldStatus={STATUS_KEPT}&PageNumber="), page.cast("string"), F.lit("&PageSize=100"))


def set_features(pages: DataFrame) -> DataFrame:
    """``run_id, page_seq, status, pager, total``: the selected status, the pagers' text and the stated total of each page."""

    def of(page: str | None) -> tuple[str, str, str]:
        top = tree.parse(page)
        select = top.first(STATUS_SELECT)
        options = select.find("option") if select else []
        chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
        return chosen.attrs.get("value", "") if chosen else "", "".join(n.text() for n in top.find(SET_PAGER)), top.first_attr(SET_TOTAL, "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pd.DataFrame([of(h) for h in rows["html"]], columns=["status", "pager", "total"])
            yield pd.concat([rows[["run_id", "page_seq"]].reset_index(drop=True), found], axis=1)

    return map_pages(pages.select("run_id", "page_seq", "html"), run, "run_id string, page_seq int, status string, pager string, total string")


def complete_sets(features: DataFrame, items: DataFrame, host: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The items (run_id, page_seq, pos, url, ...) of runs whose pages are proven to be a whole set, and ``run_id, message`` of the
    others: the first rule that fails when the pages are read in order, and on a page in this order.

    The status filter is kept; the pager states "page X of Y" with sane counts and a total that is a number; the page is
    the one asked for; page count and total are those of page 1; the page has items; each is an https URL of ``host`` below
    ``path`` and none came before. At the end there are as many items as stated. Pages after the stated last are not read; a
    page that is not landed is an error. Nothing of a run passes in part.
    """
    counts = features.select("run_id", "page_seq", "status", F.regexp_extract("pager", SET_PAGE, 1).alias("_x"), F.regexp_extract("pager", SET_PAGE, 2).alias("_y"), F.translate("total", ",", "").alias("_t"))
    counts = counts.withColumns({"x": F.col("_x").try_cast("int"), "y": F.col("_y").try_cast("int"), "t": F.when(F.col("_t") == "", F.lit(0)).otherwise(F.col("_t").try_cast("int"))})
    counts = written(counts, "set-pages")  # parsed once for the steps below
    first = counts.where("page_seq = 1").select("run_id", F.col("y").alias("pages"), F.col("t").alias("expected")).dropDuplicates(["run_id"])
    runs = counts.select("run_id").distinct().join(first, "run_id", "left")
    asked = runs.select("*", F.explode(F.sequence(F.lit(1), F.least(F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)), F.lit(MOST_SET_PAGES)))).alias("page_seq"))
    seen = asked.join(counts.withColumn("here", F.lit(True)), ["run_id", "page_seq"], "left")
    sizes = items.groupBy("run_id", "page_seq").agg(F.count("*").alias("items"))
    seen = seen.join(sizes, ["run_id", "page_seq"], "left")
    sane = F.coalesce((F.col("x") >= 1) & (F.col("y") >= F.col("x")) & (F.col("y") <= MOST_SET_PAGES), F.lit(False))
    rules = [
        (F.col("here").isNull(), F.lit("page not landed")), (F.coalesce("status", F.lit("")) != STATUS_KEPT, F.lit(NO_FILTER)), (F.coalesce("_x", F.lit("")) == "", F.lit(NO_PAGER)), (~sane, F.lit(BAD_PAGER)),
        (F.col("t").isNull() | ((F.col("_t") != "") & (F.col("t") < 1)), F.lit(BAD_TOTAL)), (F.col("x") != F.col("page_seq"), F.concat(F.lit("requested page "), "page_seq", F.lit(" but received page "), "x", F.lit("; refusing partial sync"))),
        (~(F.col("y").eqNullSafe(F.col("pages")) & F.col("t").eqNullSafe(F.col("expected"))), F.lit(CHANGED)), (F.coalesce("items", F.lit(0)) == 0, F.concat(F.lit("page "), "page_seq", F.lit(" has no usable inventory or extraction errors"))),
    ]
    broken, place = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (rule, message) in reversed(list(enumerate(rules))):
        broken, place = F.when(rule, message).otherwise(broken), F.when(rule, k).otherwise(place)
    of_pages = seen.select("run_id", F.struct("page_seq", place.alias("rule"), F.lit(0).alias("pos"), broken.alias("message")).alias("fault")).where("fault.message is not null")
    read = items.join(asked.select("run_id", "page_seq"), ["run_id", "page_seq"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("run_id", "url").orderBy("page_seq", "pos"))
    url = F.coalesce("url", F.lit(""))
    valid = (urls.scheme(url) == "https") & (urls.hostname(url) == host) & urls.path(url).startswith(path)
    fault = F.when(~valid, F.concat(F.lit('unexpected detail URL "'), url, F.lit('"'))).when(F.col("_nth") > 1, F.concat(F.lit("repeated vehicle "), url, F.lit(" on page "), "page_seq", F.lit("; refusing partial sync")))
    of_items = read.withColumn("_nth", nth).select("run_id", F.struct("page_seq", F.lit(len(rules)).alias("rule"), "pos", fault.alias("message")).alias("fault")).where("fault.message is not null")
    totals = read.groupBy("run_id").agg(F.count("*").alias("came")).join(runs, "run_id")
    short = F.concat(F.lit("collected "), "came", F.lit(" vehicles, site reports "), "expected", F.lit("; refusing partial sync"))
    of_runs = totals.where("expected > 0 and came <> expected").select("run_id", F.struct(F.lit((1 << 31) - 1).alias("page_seq"), F.lit(0).alias("rule"), F.lit(0).alias("pos"), short.alias("message")).alias("fault"))
    failed = of_pages.unionByName(of_items).unionByName(of_runs).groupBy("run_id").agg(F.min("fault")["message"].alias("message"))
    return read.join(failed, "run_id", "left_anti"), failed
