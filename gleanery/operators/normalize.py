"""Item normalisation, aliases, fill-missing and image filters as single projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import identity, text, urls
from .steps import step

YEAR = r"(?<![A-Za-z0-9_])(19[0-9]{2}|20[0-9]{2})(?![A-Za-z0-9_])"
#: Model words that are never a whole model name (fixed values).
HALF_MODELS = ("MODEL", "GRAND", "SANTA")
LABELLED = ("color", "engine", "cylinders", "horsepower", "torque", "transmission", "transmissionType", "driveType", "fuelType", "bodyType")
CLEANED = (
    "title", "price", "fuelCapacity", "fuelEconomy", "milesPerGallon", "milesPerLiter", "cityMPG", "highwayMPG", "cityMPL", "highwayMPL", "seatInfo",
    "passengerCapacity", "tireInfo", "frontTire", "rearTire", "wheelInfo", "frontWheel", "rearWheel",
)


def with_item_columns(df: DataFrame) -> DataFrame:
    """Item columns that are absent are added as missing; nulls become ''."""
    texts = {n: F.coalesce(F.col(n), F.lit("")) if n in df.columns else F.lit("") for n in schemas.ITEM_TEXTS}
    arrays = {n: F.coalesce(F.col(n), F.array().cast("array<string>")) if n in df.columns else F.array().cast("array<string>") for n in schemas.ITEM_ARRAYS}
    return df.withColumns(texts | arrays)


def with_title_words(items: DataFrame) -> DataFrame:
    """Make and model filled from the two words after the year (or after the first word), two-word models joined."""
    words = lambda t: F.array_remove(F.split(t, " "), "")
    at = F.regexp_instr("title", F.lit(YEAR))
    start = F.when(at > 0, F.size(words(F.concat(F.col("title").substr(F.lit(1), at), F.lit("|"))))).otherwise(1)
    out = step(items.withColumns({"_words": words(F.col("title")), "_start": start}), "words")
    word = lambda k: F.coalesce(F.get("_words", F.col("_start") + k), F.lit(""))
    more = F.size("_words") - F.col("_start")
    model = F.when((more > 2) & F.upper(word(1)).isin(*HALF_MODELS), F.concat_ws(" ", word(1), word(2))).otherwise(word(1))
    fill = lambda n, v: F.when((F.col(n) == "") & (more > 1), v).otherwise(F.col(n))
    return out.withColumns({"make": fill("make", word(0)), "model": fill("model", model)}).drop("_words", "_start")


def normalize(items: DataFrame, base: str = "source_url") -> DataFrame:
    """Every item field in its normal form; ``base`` is the column that relative URLs are resolved against."""
    c, given = F.col, set(items.columns)  # columns that are absent stay '' and cost nothing
    out = with_item_columns(items).withColumns({n: text.clean(c(n)) for n in CLEANED if n in given} | {n: text.strip_label(c(n)) for n in LABELLED if n in given})
    out = step(out, "cleaned")
    # Steps are kept small: the JVM does not compile a generated method of more than 8,000 bytes.
    out = out.withColumns({"stockId": identity.stock_number(c("stockId")), "mileage": text.mileage(c("mileage")), "vin": F.upper(text.clean(c("vin")))})
    out = step(out, "labelled").withColumn("url", urls.resolve(c(base), c("url")))
    out = step(out, "linked").withColumns({"primaryImage": urls.resolve(c(base), c("primaryImage")), "images": F.transform("images", lambda i: urls.resolve(c(base), i))})
    out = step(out, "resolved")
    out = out.withColumn("vin", F.when(c("vin") == "", identity.vin_in_path(c("url"))).otherwise(c("vin")))
    out = step(out, "numbered")
    own = identity.valid_vin(c("vin"))
    out = out.withColumn("stockId", F.when(identity.is_missing_stock(c("stockId")), F.when(own != "", own).otherwise(identity.listing_id(c("url")))).otherwise(c("stockId")))
    out = step(out, "stocked").withColumns({"primaryImage": F.when(identity.is_vehicle_image(c("primaryImage")), c("primaryImage")).otherwise(""), "images": identity.vehicle_images(c("images"))})
    out = step(out, "identified")
    out = out.withColumns({
        "primaryImage": F.when(c("primaryImage") == "", F.coalesce(F.get("images", F.lit(0)), F.lit(""))).otherwise(c("primaryImage")),
        "year": F.when(c("year") == "", F.regexp_extract("title", YEAR, 1)).otherwise(c("year")),
    })
    out = with_title_words(out)
    out = step(out, "titled")
    return step(fuel_conversions(out), "normalized") if given & {"fuelEconomy", "milesPerGallon", "cityMPG", "highwayMPG"} else out


def fuel_conversions(items: DataFrame) -> DataFrame:
    """Miles per gallon from the economy text, and miles per litre from each miles-per-gallon field, where missing."""
    fill = lambda to, given, value: F.when((F.col(given) != "") & (F.col(to) == ""), value(F.col(given))).otherwise(F.col(to))
    out = items.withColumn("milesPerGallon", fill("milesPerGallon", "fuelEconomy", text.mpg_value))
    return out.withColumns({to: fill(to, given, text.miles_per_litre) for to, given in (("milesPerLiter", "milesPerGallon"), ("cityMPL", "cityMPG"), ("highwayMPL", "highwayMPG"))})


def aliases(items: DataFrame, dealer: str = "dealer_id", source: str = "source_url") -> DataFrame:
    """Fills ``stock, website, dealerId, photoURLs, vehicleListPrice, style`` where they are empty."""
    c = F.col
    fill = lambda n, v: F.when(c(n) == "", v).otherwise(c(n))
    return items.withColumns({
        "stock": fill("stock", c("stockId")), "website": fill("website", c(source)), "dealerId": fill("dealerId", c(dealer)), "photoURLs": F.when(F.size("photoURLs") == 0, c("images")).otherwise(c("photoURLs")),
        "vehicleListPrice": fill("vehicleListPrice", c("price")), "style": fill("style", text.infer_style(c("title"))),
    })


def fill_missing(items: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join of enrichment rows, one a key: each field is filled where it is blank."""
    other = found.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = items.join(other, items[key] == F.col("_key"), "left")
    return joined.withColumns({f: F.when(text.trim(F.col(f)) == "", F.coalesce(F.col(f"_{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}).drop("_key", *[f"_{f}" for f in fields])


def filter_images_by_size(images: DataFrame, sizes: DataFrame, least: int = identity.LEAST_IMAGE_SIDE) -> DataFrame:
    """Images (url) whose known size (url, w, h) has both sides large enough, and images of unknown size."""
    known = sizes.select(F.col("url").alias("_url"), "w", "h")
    return images.join(known, images["url"] == known["_url"], "left").where(F.col("w").isNull() | ((F.col("w") >= least) & (F.col("h") >= least))).drop("_url", "w", "h")
