"""Pages to item rows: cards by selectors, embedded JSON, loop markup and plain patterns.

The HTML tree is parsed once a page, in Arrow batches; loop markup and patterns are Catalyst expressions. Every row
carries ``(page_seq, extractor, pos)``, the order that first-wins merging needs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html as tree
from ..functions import identity, text
from .steps import map_pages, written

# Image attributes in order, markers of placeholders, JSON spellings of fields, loop markup.
IMAGE_ATTRS = ("data-lazy", "data-lazy-src", "data-src", "data-original", "data-image", "data-srcset", "srcset", "src", ":src", "v-bind:src", "x-bind:src")
PLACEHOLDERS = ("sports_car_front_view", "/images/nophoto", "no-photo", "placeholder")
VIN_ATTRS = (("meta[itemprop='vehicleIdentificationNumber']", "content"), ("[data-vin]", "data-vin"), ("[data-vehicle-vin]", "data-vehicle-vin"), ("[data-cg-vin]", "data-cg-vin"), ("[data-vehicle-id]", "data-vehicle-id"))
JSON_FIELDS = {
    "make": ("make",), "model": ("model",), "stockId": ("stock", "stock_no", "stocknumber", "stock_number", "stockid"), "vin": ("vin", "vin_number"), "mileage": ("mileage", "miles", "odometer"),
    "engine": ("engine", "engine_description", "engine_type", "motor"), "cylinders": ("cylinders", "engine_cylinders", "cylinder"), "horsepower": ("horsepower", "hp", "engine_power"), "torque": ("torque",),
    "transmission": ("transmission", "transmission_description", "trans"), "transmissionType": ("transmission_type", "transmissiontype"), "driveType": ("drive_type", "drivetrain", "drive", "wheel_drive"),
    "fuelType": ("fuel_type", "fuel", "fueltype"), "fuelCapacity": ("fuel_capacity", "fuelcapacity", "fuel_tank_capacity"), "fuelEconomy": ("fuel_economy", "mpg", "combined_mpg"),
    "milesPerGallon": ("miles_per_gallon",), "milesPerLiter": ("miles_per_liter",), "cityMPG": ("city_mpg", "mpg_city"), "highwayMPG": ("highway_mpg", "hwy_mpg", "mpg_highway"), "cityMPL": ("city_mpl",),
    "highwayMPL": ("highway_mpl",), "bodyType": ("body_type", "body", "bodystyle", "body_style"), "seatInfo": ("seat_info", "seats", "seating"), "passengerCapacity": ("passengers", "passenger_capacity", "seating_capacity"),
    "tireInfo": ("tire_info", "tires", "tire"), "frontTire": ("front_tire", "fronttire"), "rearTire": ("rear_tire", "reartire"), "wheelInfo": ("wheel_info", "wheels", "wheel"), "frontWheel": ("front_wheel", "frontwheel"),
    "rearWheel": ("rear_wheel", "rearwheel"), "color": ("color", "exterior_color", "ext_color"), "title": ("title", "name", "vehicle_title"),
}
JSON_URLS = ("url", "vehicle_url", "vdp_url", "detail_url", "permalink", "link", "slug")
JSON_PRICES = ("price", "internet_price", "special_price", "list_price", "sale_price")
JSON_IMAGES, JSON_JOINED, JSON_GALLERIES = ("primary_image", "primary_photo", "image", "image_url", "photo"), ("all_photos", "image_urls", "photo_urls"), ("images", "photos", "gallery")
NEXT_DATA = '<script id="__NEXT_DATA__" type="application/json">'
LOOP_ITEM = '<div data-elementor-type="loop-item"'
_AMOUNT = re.compile(r"\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?)", re.ASCII)
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b", re.ASCII)
ROWS = "run_id string, page_seq int, source_url string, extractor int, pos int, item struct<" + ",".join([*(f"{n}:string" for n in schemas.ITEM_TEXTS), *(f"{n}:array<string>" for n in schemas.ITEM_ARRAYS)]) + ">"


def image_of(node: tree.Node) -> str:
    """The first usable image of an element's attributes; bound attributes must be plain quoted URLs."""
    for name in IMAGE_ATTRS:
        raw = node.attr(name)
        if name.startswith(":") or "bind:" in name:
            m = re.fullmatch(r"""(['"])((?:https?://|/)[^'"+]*)\1""", raw)
            raw = m[2] if m else ""
        low = raw.lower()
        if not raw or low.startswith("data:image/") or any(p in low for p in PLACEHOLDERS):
            continue
        if name.endswith("srcset"):
            raw = next((p.split()[0] for p in raw.split(",") if p.split()), "")
        if raw:
            return raw
    return ""


def style_url(style: str) -> str:
    m = re.search(r"""url\((?:'([^']+)'|"([^"]+)"|([^'")]+))\)""", style)
    return next((g.strip() for g in m.groups() if g and g.strip()), "") if m else ""


def card_image(card: tree.Node, selector: str) -> str:
    """The first image that looks like a vehicle, else an announced one, else a background, else any."""
    found = [(i, image_of(i)) for i in card.find(selector)]
    found = [(i, s) for i, s in found if s]
    likely = next((s for _, s in found if any(g in s.lower() for g in identity.IMAGE_SIGNS) and not any(n in s.lower() for n in identity.IMAGE_NOISE)), "")
    soon = next((s for i, s in found if any(w in i.attr("alt").lower() for w in ("coming soon", "new arrival"))), "")
    behind = ("data-bg", "data-background-image", "data-image", "data-src")
    back = next((u for n in [card, *card.walk()] for u in [style_url(n.attr("style")), *(n.attr(k) for k in behind)] if u), "")
    return likely or soon or back or (found[0][1] if found else "")


def link_score(raw: str) -> int:
    low = raw.strip().lower()
    if not low or low == "#" or low.startswith(("javascript:", "mailto:", "tel:")) or "google.com/maps" in low or "api=1&destination=" in low:
        return -100
    detail = any(p in low for p in ("/pre-owned-cars/detail/", "/vehicle-details/", "/inventory/", "/viewdetails/"))
    return 10 * detail + 2 * low.startswith("/") - 10 * ("google." in low.split("/")[2] if "://" in low else False) - 3 * any(w in low for w in ("compare", "schedule", "finance", "service"))


def vin_of(raw: str) -> str:
    v = raw.strip().removeprefix("vehicle-id-").upper()
    return v if len(v.encode()) == 17 and not set(v) & set("IOQ") and any(c.isdigit() for c in v) else ""


def card_item(card: tree.Node, site: dict) -> dict:
    """A card's fields before normalisation, by the template's selectors and then by attributes that platforms share."""
    pick = lambda name: card.first_text(site.get(name, ""))
    links = [n.attrs["href"] for n in card.find(site.get("urlSelector", "")) if n.attr("href")]
    best = max(links, key=link_score, default="")
    price = pick("priceSelector")
    if not _AMOUNT.search(price) and (m := _AMOUNT.search(card.text())):
        price = "$" + m[1]
    image = card_image(card, site.get("imageSelector", ""))
    vins = [vin_of(card.attr("data-vehicle-id")), *(vin_of(card.first_attr(s, a)) if "itemprop" not in s else card.first_attr(s, a) for s, a in VIN_ATTRS)]
    return {
        "title": pick("titleSelector") or card.first_attr("meta[itemprop='name']", "content") or card.first_attr("[data-dws-title]", "data-dws-title"),
        "url": best if best and link_score(best) >= 0 else card.first_attr("meta[itemprop='url']", "content"),
        "stockId": pick("stockSelector") or card.first_attr("meta[itemprop='sku']", "content") or card.first_attr("[data-vehicle-stock-no]", "data-vehicle-stock-no"),
        "vin": next((v for v in [*vins[1:], vins[0]] if v), ""), "price": price, "mileage": pick("mileageSelector"), "primaryImage": image, "images": [image] if image else [],
    }


def loose(key: str) -> str:
    return key.translate({ord(c): None for c in "_- "}).lower()


def json_text(obj: dict, *keys: str) -> str:
    """The first non-blank of several keys, exact spelling before loose; numbers without decimals."""
    named = {}
    for k, v in obj.items():
        named.setdefault(loose(k), v)
    for key in keys:
        v = obj[key] if key in obj else named.get(loose(key))
        if isinstance(v, str) and v.strip():
            return v
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{v:.0f}"
    return ""


def json_item(obj: dict) -> dict | None:
    """A vehicle from a JSON object that has three of make, model, year, stock and URL, else None."""
    it = {field: json_text(obj, *keys) for field, keys in JSON_FIELDS.items()}
    year = json_text(obj, "year", "model_year")
    it["year"] = m[0] if (m := _YEAR.search(year)) else year if len(year) == 4 else ""
    it["url"] = next((u for k in JSON_URLS if (u := json_text(obj, k)).startswith(("/", "http://", "https://"))), "")
    if sum(bool(it[k]) for k in ("make", "model", "year", "stockId", "url")) < 3:
        return None
    price = next((v for k in JSON_PRICES if (v := obj.get(k)) and (isinstance(v, str) and v.strip() or isinstance(v, (int, float)) and v > 0)), "")
    it["price"] = price if isinstance(price, str) else f"{price:.0f}"
    it["title"] = it["title"] or " ".join(v for v in (it["year"], it["make"], it["model"]) if v)
    raw = [json_text(obj, k) for k in JSON_IMAGES] + [p for k in JSON_JOINED if "," in (j := json_text(obj, k)) for p in j.split(",")]
    named = {loose(k): v for k, v in reversed(obj.items())}
    for k in JSON_GALLERIES:
        for e in named.get(loose(k)) if isinstance(named.get(loose(k)), list) else []:
            raw += [e] if isinstance(e, str) else [json_text(e, u) for u in ("url", "src", "image", "photo")] if isinstance(e, dict) else []
    images = list(dict.fromkeys(s for r in raw if (s := r.strip()).startswith(("http://", "https://", "/"))))
    return it | {"images": images, "primaryImage": images[0] if images else ""}


def json_objects(value):
    """Every object of a JSON value, parents before children, in document order."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack.extend(reversed(v.values()))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def next_data_items(html: str) -> list[dict]:
    _, found, rest = html.partition(NEXT_DATA)
    body, closed, _ = rest.partition("</script>")
    if not found or not closed:
        return []
    try:
        items = [i for o in json_objects(json.loads(body)) if (i := json_item(o))]
    except ValueError:
        return []
    return list({(i["url"], i["stockId"], i["vin"], i["title"]): i for i in reversed(items)}.values())[::-1]


def structured_rows(pages: DataFrame, site: dict) -> DataFrame:
    """Rows of the card (2) and embedded JSON (3) extractors of ``run_id, page_seq, url, html`` under a template."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = dict.fromkeys(schemas.ITEM_TEXTS, "") | {n: [] for n in schemas.ITEM_ARRAYS}
        for rows in batches:
            out = []
            for run_id, seq, url, html in zip(rows["run_id"], rows["page_seq"], rows["url"], rows["html"], strict=True):
                cards = [card_item(c, site) for c in tree.parse(html).find(site.get("cardSelector", ""))]
                for kind, items in ((2, cards), (3, next_data_items(html or ""))):
                    out += [(run_id, seq, url, kind, k, blank | i) for k, i in enumerate(items)]
            yield pd.DataFrame(out, columns=["run_id", "page_seq", "source_url", "extractor", "pos", "item"])

    return map_pages(pages.select("run_id", "page_seq", "url", "html"), run, ROWS)


def _item(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit("")).alias(n) for n in schemas.ITEM_TEXTS], *[given.get(n, F.array().cast("array<string>")).alias(n) for n in schemas.ITEM_ARRAYS]).alias("item")


def loop_rows(pages: DataFrame) -> DataFrame:
    """Rows (extractor 1) of loop markup: the page is split at its items and fields are matched in each part."""
    parts = pages.select("run_id", "page_seq", F.col("url").alias("source_url"), F.posexplode(F.split("html", LOOP_ITEM.replace('"', '\\"'))).alias("pos", "part")).where("pos > 0")
    got = lambda pattern, k=1, c=F.col("part"): F.regexp_extract(c, pattern, k)
    classes = F.regexp_extract(F.concat(F.lit(LOOP_ITEM), "part"), r'(?is)<div[^>]+class="([^"]+)"', 1)
    named = lambda n: text.clean(F.translate(got(rf"(?:^|\s){n}-([a-zA-Z0-9\-]+)(?:\s|$)", c=F.col("classes")), "-", " "))
    lazy, plain = got(r'(?is)<img[^>]+data-src="([^"]+)"'), got(r'(?is)<img[^>]+src="([^"]+)"')
    image = F.when(lazy != "", lazy).when(~plain.startswith("data:image/"), plain).otherwise("")
    stock, slug = got(r"(?is)STOCK#\s*([A-Za-z0-9\-]+)"), F.upper(F.translate(got(r"(?:^|\s)stock-([a-zA-Z0-9\-]+)(?:\s|$)", c=F.col("classes")), "-", ""))
    head, link = got(r'(?is)<h[1-4][^>]*>\s*<a[^>]*href="[^"]*vehicle-details/[^"]+"[^>]*>([^<]+)</a>'), got(r'(?is)<a[^>]*href="[^"]*vehicle-details/[^"]+"[^>]*>([^<]+)</a>')
    price, miles = got(r"(?is)\$\s*([0-9][0-9,]*)"), got(r"(?is)([0-9][0-9,]*)\s*(?:miles?|mi(?![A-Za-z0-9_]))")
    made = _item(
        url=got(r'(?is)href="([^"]*vehicle-details/[^"]+)"'), primaryImage=image, images=F.filter(F.array(image), lambda i: i != ""), stockId=F.when(stock != "", stock).otherwise(slug), title=F.when(head != "", head).otherwise(link),
        price=F.when(price != "", F.concat(F.lit("$"), price)).otherwise(""), mileage=F.when(miles != "", F.concat(miles, F.lit(" mi"))).otherwise(""), make=named("make"), model=named("model"),
    )
    return parts.withColumn("classes", classes).where(F.col("classes").contains("vehicle type-vehicle")).select("run_id", "page_seq", "source_url", F.lit(1).alias("extractor"), "pos", made)


def pattern_rows(pages: DataFrame, patterns: list[str]) -> DataFrame:
    """Stock-only rows (extractor 4) of every match of the template's patterns."""
    found = [F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), lambda v: v) for p in patterns]
    every = F.flatten(F.array(*found)) if found else F.array().cast("array<string>")
    return pages.select("run_id", "page_seq", F.col("url").alias("source_url"), F.lit(4).alias("extractor"), F.posexplode(every).alias("pos", "stock")).select("run_id", "page_seq", "source_url", "extractor", "pos", _item(stockId=F.col("stock")))


def extract(pages: DataFrame, site: dict) -> DataFrame:
    """All extractors' rows in order; patterns count only for pages where the others found nothing.

    Returned: ``run_id, source_url, page_seq, extractor, pos`` and the item columns.
    """
    rows = loop_rows(pages).unionByName(structured_rows(pages, site))
    if not site.get("stockPatterns"):
        return rows.select("run_id", "source_url", "page_seq", "extractor", "pos", "item.*")
    rows = written(rows, "extracted-rows")  # read twice, parsed once
    bare = pattern_rows(pages, site.get("stockPatterns", [])).join(rows.select("run_id", "page_seq").distinct(), ["run_id", "page_seq"], "left_anti")
    return rows.unionByName(bare.select(rows.columns)).select("run_id", "source_url", "page_seq", "extractor", "pos", "item.*")
