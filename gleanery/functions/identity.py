"""Vehicle identity expressions: identification numbers, stock numbers, listing ids, images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import clean, trim

# How stock numbers are labelled, what counts as none, and what tells vehicle images from decoration.
STOCK_TOKEN = r"(?i)(?<![A-Za-z0-9_])stock[\t\n\f\r ]*#?[:\-]?[\t\n\f\r ]*([a-z0-9\-]+)(?![A-Za-z0-9_])"
BARE_STOCK_LABEL = r"(?i)^[\t\n\f\r ]*(?:stock[\t\n\f\r ]*(?:number|no\.?|#)?)?[\t\n\f\r ]*[#:\-]*[\t\n\f\r ]*$"
STOCK_LABEL_WORDS = ("", "number", "num", "no")
NO_STOCK = ("", "N/A", "NA", "NONE", "—", "-")
IMAGE_NOISE = ("/logo", "logo_", "seal", "icon-", "icon_", "favicon", "sprite", "dealerrater", "calendly", "/css/", "/js/", ".svg")
IMAGE_SIGNS = (
    "vehicle", "inventory", "wp-content/uploads", "stock", "vin=", "new-arrival", "new_arrival", "photos-coming-soon", "coming-soon",
    "picture-coming-soon", "no-photo", ".jpg", ".jpeg", ".png", ".webp", "/fit-in/", "filters:", "/resize/", "cloudfront.net", "/photos/",
    "cloudflareimages.dealereprocess.com",
)
LEAST_IMAGE_SIDE = 300


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def valid_vin(c: Column) -> Column:
    """The upper-case number if it has 17 bytes, no I, O or Q, and a digit; else ''."""
    v = F.upper(trim(c))
    return F.when((F.octet_length(v) == 17) & ~v.rlike("[IOQ]") & v.rlike("[0-9]"), v).otherwise("")


def structured_vin(c: Column) -> Column:
    """Also 11 to 16 letters and digits with a digit, from a field that is labelled as the number."""
    v = F.upper(trim(c))
    return F.when(valid_vin(c) != "", valid_vin(c)).when(v.rlike("^[A-Z0-9]{11,16}$") & v.rlike("[0-9]"), v).otherwise("")


def _first_valid(found: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(found, valid_vin), lambda v: v != ""), F.lit(0)), F.lit(""))


def vin_in_text(c: Column) -> Column:
    return _first_valid(F.regexp_extract_all(F.upper(c), F.lit(r"(?<![A-Za-z0-9_])([A-HJ-NPR-Z0-9]{17})(?![A-Za-z0-9_])"), F.lit(1)))


def vin_in_path(url: Column) -> Column:
    p = F.when(urls.path(url) != "", urls.path(url)).otherwise(url)
    found = _first_valid(F.regexp_extract_all(p, F.lit(r"(?i)/([A-HJ-NPR-Z0-9]{17})(?:/|$)"), F.lit(1)))
    return F.when(url.rlike("/[A-Za-z0-9]{17}"), found).otherwise("")  # most URLs have no such segment


def is_stock_label_word(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[ .:#\-]+|[ .:#\-]+$", "")).isin(*STOCK_LABEL_WORDS)


def stock_number(c: Column) -> Column:
    """Upper-case stock number without its label; a bare label gives ''."""
    s = clean(c)
    token = F.when(F.lower(s).contains("stock"), F.regexp_extract(s, STOCK_TOKEN, 1)).otherwise("")
    rest = clean(F.regexp_replace(s, "^#", ""))
    plain = F.when(rest.rlike(BARE_STOCK_LABEL), "").otherwise(F.upper(rest))
    return F.when(s == "", "").when((token != "") & ~is_stock_label_word(token), F.upper(token)).otherwise(plain)


def is_missing_stock(c: Column) -> Column:
    return F.upper(clean(c)).isin(*NO_STOCK)


def plausible_stock(c: Column) -> Column:
    v = trim(c)
    return F.when((v == "") | is_stock_label_word(v) | v.rlike(r"^(?:19|20)[0-9]{2}$") | ~v.rlike("[0-9]"), "").otherwise(v)


def stock_in_text(c: Column) -> Column:
    return plausible_stock(F.regexp_extract(trim(c), STOCK_TOKEN, 1))


def listing_id(url: Column) -> Column:
    """The numeric last path segment, else ''."""
    return F.regexp_extract(urls.path(trim(url)), "/([0-9]+)/*$", 1)


def is_vehicle_image(url: Column, low: Column | None = None) -> Column:
    """``low`` is the URL in lower case, where the caller has it."""
    u = F.lower(url) if low is None else low
    hint = r"-([0-9]+)x([0-9]+)\.(?:jpg|jpeg|png|webp)(?:[?#]|$)"
    side = lambda k: F.coalesce(F.nullif(F.regexp_extract(u, hint, k), F.lit("")).try_cast("int"), F.lit(0))
    small = ((side(1) > 0) & (side(1) < LEAST_IMAGE_SIDE)) | ((side(2) > 0) & (side(2) < LEAST_IMAGE_SIDE))
    return (url != "") & ~u.startswith("data:image/") & contains_any(u, IMAGE_SIGNS) & ~contains_any(u, IMAGE_NOISE) & ~(u.rlike(hint) & small)


def vehicle_images(urls: Column) -> Column:
    """The URLs of vehicle images, each once; lambdas repeat what they name, so each URL is lowered before."""
    both = F.transform(urls, lambda i: F.struct(i.alias("url"), F.lower(i).alias("low")))
    return F.array_distinct(F.transform(F.filter(both, lambda i: is_vehicle_image(i["url"], i["low"])), lambda i: i["url"]))
