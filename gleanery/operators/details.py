"""Detail pages joined to items: label/value pairs, fields filled from them, image lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as tree
from ..functions import urls
from .extract import image_of, vin_of
from .steps import map_pages

# Labels by field, in order of trust; labels of numbers; body types; classes of named title/value blocks.
LABELS = {
    "make": ("make",), "model": ("model",), "year": ("year",), "color": ("exterior color", "ext color"), "mileage": ("mileage", "miles", "odometer"),
    "engine": ("engine", "engine type", "engine description"), "cylinders": ("cylinders", "cylinder"), "horsepower": ("horsepower", "hp"), "torque": ("torque",),
    "transmission": ("transmission",), "transmissionType": ("transmission type",), "driveType": ("drivetrain", "drive train", "drive type", "drive"),
    "fuelType": ("fuel type", "fuel"), "fuelCapacity": ("fuel capacity", "fuel tank capacity"), "fuelEconomy": ("fuel economy", "combined mpg", "mpg"),
    "cityMPG": ("city mpg", "city"), "highwayMPG": ("highway mpg", "hwy mpg", "hwy", "highway"), "bodyType": ("body type", "body style", "body", "style"),
    "style": ("style", "trim"), "seatInfo": ("seat info", "seats", "seating"), "passengerCapacity": ("passengers", "passenger capacity", "seating capacity"),
    "tireInfo": ("tire", "tires"), "frontTire": ("front tire",), "rearTire": ("rear tire",), "wheelInfo": ("wheel", "wheels"), "frontWheel": ("front wheel",), "rearWheel": ("rear wheel",),
}
IDENTITY = {"vin": ("vin",), "stockId": ("stock", "stock number", "stock no", "stock id", "stock #")}
BODIES = ("SEDAN", "COUPE", "CONVERTIBLE", "HATCHBACK", "WAGON", "SUV", "TRUCK", "VAN", "MINIVAN", "ROADSTER")
BLOCK_TITLE, BLOCK_VALUE = ".vdp-info-block__info-item-title", ".vdp-info-block__info-item-description"
NAMED = {"engine": "engine", "transmission": "transmission", "driveType": "drivetrain", "color": "exterior color"}
DRIVES = (("AWD", "all wheel drive"), ("FWD", "front wheel drive"), ("RWD", "rear wheel drive"), ("4WD", "four wheel drive"))
KNOWN = {"color", *(x for labels in (*LABELS.values(), *IDENTITY.values()) for x in labels)}
#: Bytes of a text that may be one label with its value, and of one that may be a bare value.
MOST_PAIR, MOST_TILE = 160, 80
LEAST_SIDE = 300
#: ``found`` fills blanks, ``named`` replaces what an item has; ``large`` are the images that the page states to be so.
SCHEMA = "url string, found map<string,string>, named map<string,string>, images array<string>, large array<string>"

# The patterns of bare values.
_flags = re.I | re.A
_MILES = re.compile(r"\b([0-9][0-9,]*)\s*(miles?|mi)\b", _flags)
_GEARS = re.compile(r"\b([0-9]{1,2}\s*speed|automatic|manual|dual\s+clutch|cvt)\b", _flags)
_ENGINE = re.compile(r"\b(v[0-9]{1,2}|i[0-9]|[0-9](?:\.[0-9])?\s*l(?:iter)?|[0-9]+\s*cylinders?)\b", _flags)
_CYLINDERS = re.compile(r"\b([0-9]{1,2}\s*cylinders?)\b", _flags)
_ECONOMY = re.compile(r"\b([0-9]{1,3}\s*mpg)\b", _flags)
_CITY = re.compile(r"\b([0-9]{1,3})\s*city\s*mpg\b|\bcity\s*mpg\s*([0-9]{1,3})\b", _flags)
_HIGHWAY = re.compile(r"\b([0-9]{1,3})\s*(?:hwy|highway)\s*mpg\b|\b(?:hwy|highway)\s*mpg\s*([0-9]{1,3})\b", _flags)
_COLOR = re.compile(r"\b(?:exterior\s+color|color)\b[:\s]+([a-z0-9][a-z0-9\s\-/]{1,40})", _flags)


def clean(raw: str) -> str:
    return " ".join(raw.split())


def known_label(raw: str) -> str:
    """A text as a canonical label, '' if it is none."""
    label = clean(re.sub("[_-]", " ", clean(raw).lower().strip(" :-#")))
    return label if label in KNOWN else ""


def label_and_value(text: str) -> tuple[str, str]:
    """A text cut after its label: at the first colon, else number sign, else after the fewest words that are a label."""
    for sign in ":#":
        before, cut, after = text.partition(sign)
        if cut and (label := known_label(before)) and (value := clean(after)):
            return label, value
    words = text.split()
    cuts = ((known_label(" ".join(words[:i])), " ".join(words[i:])) for i in range(1, len(words)))
    return next((c for c in cuts if c[0]), ("", ""))


def _following(doc: tree.Node) -> dict[int, tree.Node]:
    """Each element's next sibling element."""
    out = {}
    for parent in (doc, *doc.walk()):
        inner = [c for c in parent.children if isinstance(c, tree.Node)]
        out.update({id(a): b for a, b in zip(inner, inner[1:], strict=False)})
    return out


def named_blocks(doc: tree.Node, after: dict[int, tree.Node]) -> dict[str, str]:
    """Pairs of named title and value elements: the element behind a title, else the first value element behind it."""
    out = {}
    for title in doc.find(BLOCK_TITLE):
        label, at = clean(title.text()).lower(), after.get(id(title))
        value = clean(at.text()) if at else ""
        while at and not value:
            value = clean(at.text()) if BLOCK_VALUE[1:] in at.attr("class").split() else ""
            at = after.get(id(at))
        if label and value:
            out[label] = value
    return out


def pairs(doc: tree.Node, after: dict[int, tree.Node]) -> dict[str, str]:
    """Label/value pairs of table rows, definition lists, single texts and neighbouring elements; the last of a label stays."""
    out = {}
    for row in doc.find("tr"):
        if len(cells := row.find("th, td")) > 1:
            out[clean(cells[0].text()).lower()] = clean(cells[1].text()) or out.get(clean(cells[0].text()).lower(), "")
    behind = lambda n: clean(after[id(n)].text()) if id(n) in after else ""
    for term in doc.find("dt"):
        if value := behind(term):
            out[clean(term.text()).lower()] = value
    for node in doc.find("li, div, p, span"):
        text = clean(node.text())
        if text and len(text.encode()) <= MOST_PAIR:
            label, value = label_and_value(text)
            out[label] = value
    for node in doc.find("li, div, p, span, strong, b"):
        if (label := known_label(node.text())) and (value := behind(node)) and not known_label(value):
            out[label] = value
    return {k: v for k, v in (out | named_blocks(doc, after)).items() if k and v}


def tile(text: str) -> dict[str, str]:
    """Fields that a short text without a label gives away."""
    upper, number = text.upper(), lambda m: f"{m[1] or m[2]} MPG" if m else ""
    out = {
        "mileage": f"{m[1]} {m[2].lower()}" if (m := _MILES.search(text)) else "",
        "driveType": text if any(short in upper or words in upper.lower() for short, words in DRIVES) else "",
        "transmission": text if _GEARS.search(text) else "",
        "transmissionType": next((kind for kind in ("Automatic", "Manual") if kind.upper() in upper), ""),
        "engine": text if _ENGINE.search(text) else "",
        "cylinders": m[1] if (m := _CYLINDERS.search(text)) else "",
        "fuelEconomy": m[1] if (m := _ECONOMY.search(text)) else "",
        "cityMPG": number(_CITY.search(text)),
        "highwayMPG": number(_HIGHWAY.search(text)),
        "bodyType": text if upper.strip() in BODIES else "",
    }
    return {k: v for k, v in out.items() if v}


def value_of(found: dict[str, str], labels: tuple[str, ...]) -> str:
    """By label: equal, then starting with it and a colon, then containing it; ties by place in the document."""
    for want in labels:
        for fits in (lambda k: k == want, lambda k: k.startswith(want + ":"), lambda k: want in k):  # noqa: B023
            if hit := next((v for k, v in found.items() if fits(k)), ""):
                return hit
    return ""


def dimension(node: tree.Node, name: str) -> int:
    """A stated side, 0 if there is none."""
    stated = (node.attr(name), node.attr(f"data-{name}"))
    return next((int(v) for v in stated if v.isascii() and v.isdigit() and int(v) > 0), 0)


def page_images(doc: tree.Node, selector: str) -> tuple[list[str], list[str]]:
    """Images that the page does not state to be small, and those of them that it states to be large."""
    images, large = [], []
    for node in doc.find(selector):
        sides = [dimension(node, name) for name in ("width", "height")]
        image = image_of(node) or node.attr("href")
        if image and not any(0 < side < LEAST_SIDE for side in sides):
            images.append(image)
            large += [image] * (min(sides) >= LEAST_SIDE)
    return list(dict.fromkeys(images)), list(dict.fromkeys(large))


def page_details(html: str | None, site: dict) -> tuple[dict[str, str], dict[str, str], list[str], list[str]]:
    """Fields that fill blanks, fields that replace, images of a page, and those of them that it states to be large.

    A bare value comes before a labelled one. ``drive label`` is the labelled drive type alone: it also replaces a drive
    type that still holds its own label.
    """
    doc = tree.parse(re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1>", "", html or ""))
    after = _following(doc)
    found = pairs(doc, after)
    labelled = {field: value_of(found, labels) for field, labels in (LABELS | IDENTITY).items()}
    labelled["color"] = labelled["color"] or found.get("color", "") or (clean(m[1]) if (m := _COLOR.search(doc.text())) else "")
    tiles: dict[str, str] = {}
    for node in doc.find("li, div, p, span"):
        text = clean(node.text())
        if text and len(text.encode()) <= MOST_TILE:
            tiles = tile(text) | tiles
    fields = {**labelled, **tiles, "drive label": labelled["driveType"]}
    if "drivetrain" in fields["driveType"].lower():
        fields["driveType"] = labelled["driveType"] or fields["driveType"]
    fields["vin"] = vin_of(fields["vin"]) or vin_of(doc.first_text(site.get("vinSelector", ""))) or next((v for m in re.findall(r"\b[A-HJ-NPR-Z0-9]{17}\b", doc.text().upper()) if (v := vin_of(m))), "")
    fields["stockId"] = fields["stockId"] or doc.first_text(site.get("stockSelector", "")).strip()
    blocks = named_blocks(doc, after)
    return {k: v for k, v in fields.items() if v}, {f: blocks[x] for f, x in NAMED.items() if x in blocks}, *page_images(doc, site.get("imageSelector", ""))


def parse_details(details: DataFrame, site: dict) -> DataFrame:
    """``url, found, named, images, large`` of landed detail pages (url, html), each parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [page_details(h, site) for h in rows["html"]]
            yield pd.DataFrame({"url": rows["url"], "found": [g[0] for g in got], "named": [g[1] for g in got], "images": [g[2] for g in got], "large": [g[3] for g in got]})

    return map_pages(details.select("url", "html"), run, SCHEMA)


def without_small_images(parsed: DataFrame, sizes: DataFrame, least: int = LEAST_SIDE) -> DataFrame:
    """Parsed pages without the images that are known to be small by ``sizes`` (url, w, h), and that the page does not state
    to be large. Images are compared by their URLs as the page's own URL resolves them; those of no known size stay."""
    images = parsed.select("url", F.posexplode("images").alias("pos", "image"), "large")
    known = sizes.select(F.col("url").alias("_at"), "w", "h")
    kept = images.withColumn("_at", urls.resolve(F.col("url"), F.col("image"))).join(known, "_at", "left")
    kept = kept.where(F.array_contains("large", F.col("image")) | F.col("w").isNull() | (F.least("w", "h") >= least))
    lists = kept.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "image"))), lambda x: x["image"]).alias("_kept"))
    return parsed.join(lists, "url", "left").withColumn("images", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")


def enrich(items: DataFrame, details: DataFrame, site: dict, sizes: DataFrame | None = None) -> DataFrame:
    """Items with blank fields filled from their detail page, and those of named blocks replaced; found images replace the
    list's, without those that ``sizes`` (url, w, h) knows to be small. Normalise afterwards."""
    parsed = parse_details(details, site).dropDuplicates(["url"])
    parsed = parsed if sizes is None else without_small_images(parsed, sizes)
    pages = parsed.select(F.col("url").alias("_url"), "found", "named", F.col("images").alias("_images"))
    joined = items.join(pages, items["url"] == F.col("_url"), "left")
    of = lambda column, key: F.try_element_at(column, F.lit(key))
    fill = {f: F.when(F.col(f) == "", F.coalesce(of("found", f), F.lit(""))).otherwise(F.col(f)) for f in LABELS | IDENTITY}
    fill["driveType"] = F.when(F.lower("driveType").contains("drivetrain"), F.coalesce(of("found", "drive label"), "driveType")).otherwise(fill["driveType"])
    fill |= {f: F.coalesce(of("named", f), fill[f]) for f in NAMED}
    images = F.when(F.size(F.coalesce("_images", F.array())) > 0, F.col("_images")).otherwise(F.col("images"))
    return joined.withColumns(fill | {"images": images}).drop("_url", "found", "named", "_images")
