"""Landed platform payloads to item rows: one schema and one projection a platform, no HTML in between.

Input: ``run_id, source_url, page_seq, payload`` (JSON text). Output: ``run_id, source_url, page_seq, pos`` and item
columns. Payloads that do not parse give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import identity, text

ATTR = "array<struct<name:string,value:string>>"
# The platforms' payload fields.
DEALER_DOT_COM = f"WIS struct<inventory:array<struct<vin:string,stockNumber:string,year:int,make:string,model:string,trim:string,title:array<string>,link:string,bodyStyle:string,fuelType:string,images:array<struct<uri:string>>,pricing:struct<retailPrice:string,dprice:array<struct<value:string,isFinalPrice:boolean>>>,attributes:{ATTR},trackingAttributes:{ATTR},highlightedAttributes:{ATTR}>>>"
DEALER_ON = "DisplayCards array<struct<VehicleCard:struct<VehicleVin:string,VehicleYear:int,VehicleMake:string,VehicleModel:string,VehicleTrim:string,VehicleStockNumber:string,Mileage:string,VehicleInternetPrice:double,VehicleDetailUrl:string,VehicleImageModel:struct<VehiclePhotoSrc:string>,WasabiVehiclePricingPanelViewModel:struct<PriceStakViewModel:struct<PriceStakTabsModel:struct<BuyContent:string>>>>>>"
DEALER_SYNC = "Vehicles array<struct<Vin:string,StockNo:string,VehicleTitle:string,VehicleName:string,Year:string,Make:string,Model:string,Trim:string,Mileage:int,FinalPrice:double,InternetPrice:double,VehicleDetailUrl:string,FirstImageUrl:string>>"
DRIVEN_MOTION = "props struct<pageProps:struct<inventory:struct<results:array<struct<vin:string,stocknumber:string,year:int,make:string,model:string,trim:string,price:double,mileage:double,status:string,wholesale:int,dealer_id:int,url:string,photos:array<string>,exteriorcolor:string,body:string,fuel:string,drivetrainstandard:string>>>>>"
HORNE = "vehicles array<struct<id:int,vin:string,stockNumber:string,year:int,make:string,model:string,trim:string,hornePrice:double,mileage:double,status:string,exteriorColor:string,drivetrain:string,transmission:string,engineDescription:string,bodyClass:string,fuelType:string,photos:array<struct<url:string>>>>"
IMOTOR = "results array<struct<hits:array<struct<id:int,vehType:string,make:string,model:string,year:int,price:double,odometer:double,vin:string,images:array<string>>>>>"
SPACE_AUTO = "vehicles array<struct<vin:string,stock:string,year:int,make:string,model:string,trim:string,price:double,discountedPrice:double,mileage:double,color:string,body:string,driveline:string,fuel:string,engine:string,engineCylinderCount:int,transmission:string,cityMPG:double,highwayMPG:double,photos:array<string>>>"



def _rows(payloads: DataFrame, schema: str, path: str, *carried: str) -> DataFrame:
    parsed = payloads.select("run_id", "source_url", "page_seq", *carried, F.from_json("payload", schema).alias("j"))
    return parsed.select("run_id", "source_url", "page_seq", *carried, F.posexplode(f"j.{path}").alias("pos", "v"))


def _item(rows: DataFrame, **given: Column) -> DataFrame:
    texts = {n: F.coalesce(given.get(n, F.lit("")).cast("string"), F.lit("")) for n in schemas.ITEM_TEXTS}
    images = F.coalesce(given.get("images", F.array().cast("array<string>")), F.array().cast("array<string>"))
    if "primaryImage" not in given:
        texts["primaryImage"] = F.coalesce(F.get(images, F.lit(0)), F.lit(""))
    return rows.select("run_id", "source_url", "page_seq", "pos", *[texts[n].alias(n) for n in schemas.ITEM_TEXTS], images.alias("images"), F.array().cast("array<string>").alias("photoURLs"))


def blank(c: Column) -> Column:
    return text.trim(F.coalesce(c, F.lit(""))) == ""


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.when(~blank(c), text.trim(c)) for c in cols], F.lit(""))


def joined(*cols: Column) -> Column:
    """The non-blank values, trimmed, joined by a space."""
    return F.array_join(F.filter(F.transform(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), text.trim), lambda x: x != ""), " ")


def positive(c: Column) -> Column:
    return F.when(c > 0, c.cast("string"))


def whole(c: Column) -> Column:
    """A number without decimals, half to even."""
    return F.format_string("%.0f", F.bround(c, 0))


def grouped(c: Column) -> Column:
    """An integer with thousands separators; '' unless positive."""
    return F.when(F.bround(c, 0) > 0, F.format_number(F.bround(c, 0), 0)).otherwise("")


def money(c: Column) -> Column:
    return F.when(grouped(c) != "", F.concat(F.lit("$"), grouped(c))).otherwise("")


def filled(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (text.trim(x) != ""))


def unescape(c: Column) -> Column:
    """A payload's text without character references and outer spaces."""
    return text.trim(text.html_unescape(c))


def once(rows: DataFrame, key: Column) -> DataFrame:
    """The first row of each key in a run; rows without a key go."""
    first = F.row_number().over(Window.partitionBy("run_id", "_key").orderBy("page_seq", "pos"))
    return rows.withColumn("_key", key).where("_key <> ''").withColumn("_nth", first).where("_nth = 1").drop("_key", "_nth")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def rooted(base: Column, url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), url)).when(url.startswith("/"), F.concat(origin(base), url)).otherwise(url)


def attribute(v: Column, *names: str) -> Column:
    """By name, then by list (own, highlighted, tracking): the first non-blank value."""
    lists = [F.coalesce(v[f], F.array().cast(ATTR)) for f in ("attributes", "highlightedAttributes", "trackingAttributes")]

    def named(name: str) -> Column:
        return F.get(F.filter(F.concat(*lists), lambda a: (F.lower(a["name"]) == name.lower()) & ~blank(a["value"])), F.lit(0))["value"]

    return first_filled(*map(named, names))


def dealer_dot_com(payloads: DataFrame) -> DataFrame:
    """Final price over retail price, odometer without its unit, attributes by priority."""
    rows, v = _rows(payloads, DEALER_DOT_COM, "WIS.inventory"), F.col("v")
    title = first_filled(unescape(F.array_join(v["title"], " ")), joined(positive(v["year"]), unescape(v["make"]), unescape(v["model"]), unescape(v["trim"])))
    final = F.get(F.filter(v["pricing"]["dprice"], lambda d: d["isFinalPrice"] & ~blank(d["value"])), F.lit(0))["value"]
    return _item(
        rows.where(title != ""), title=title, url=v["link"], vin=identity.structured_vin(F.coalesce(v["vin"], F.lit(""))), stockId=v["stockNumber"], year=positive(v["year"]), make=unescape(v["make"]), model=unescape(v["model"]), bodyType=v["bodyStyle"], fuelType=v["fuelType"],
        price=first_filled(final, v["pricing"]["retailPrice"]), mileage=F.regexp_replace(attribute(v, "odometer"), r"(?i)\s*(?:miles|mi)\.?\s*$", ""), images=filled(F.transform(v["images"], lambda i: i["uri"])), color=attribute(v, "exteriorColor"), engine=attribute(v, "engine"),
        transmission=attribute(v, "transmission"), driveType=attribute(v, "normalDriveLine", "driveLine"), cityMPG=attribute(v, "cityFuelEconomy"), highwayMPG=attribute(v, "highwayFuelEconomy"),
    )


def panel_price(html: Column) -> Column:
    """A pricing panel's "$ amount ... PRICE", else the first labelled price that is not the list price, else that."""
    plain = text.clean(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))
    first = F.regexp_extract(plain, r"\$([0-9,]+)\s+[A-Z][A-Z ]*PRICE", 1)
    labels = F.regexp_extract_all(plain, F.lit(r"(?i)([a-z ]*price)\s*:?\s*-?\$([0-9,]+)"), F.lit(1))
    amounts = F.regexp_extract_all(plain, F.lit(r"(?i)([a-z ]*price)\s*:?\s*-?\$([0-9,]+)"), F.lit(2))
    pairs = F.arrays_zip(labels.alias("label"), amounts.alias("amount"))
    own = F.filter(pairs, lambda p: ~F.lower(p["label"]).contains("suggested") & ~F.lower(p["label"]).contains("msrp"))
    amount = F.coalesce(F.nullif(first, F.lit("")), F.get(own, F.lit(0))["amount"], F.get(pairs, F.lit(0))["amount"])
    return F.coalesce(F.concat(F.lit("$"), amount), F.lit(""))


def dealer_on(payloads: DataFrame) -> DataFrame:
    """Vehicles once by number; internet price, else the panel's."""
    rows = once(_rows(payloads, DEALER_ON, "DisplayCards").withColumn("v", F.col("v.VehicleCard")), F.coalesce("v.VehicleVin", F.lit("")))
    v = F.col("v")
    price = F.when(v["VehicleInternetPrice"] > 0, F.concat(F.lit("$"), whole(v["VehicleInternetPrice"]))).otherwise(panel_price(v["WasabiVehiclePricingPanelViewModel"]["PriceStakViewModel"]["PriceStakTabsModel"]["BuyContent"]))
    image = rooted(F.col("source_url"), text.trim(F.coalesce(v["VehicleImageModel"]["VehiclePhotoSrc"], F.lit(""))))
    return _item(rows, title=joined(v["VehicleYear"], v["VehicleMake"], v["VehicleModel"], v["VehicleTrim"]), url=v["VehicleDetailUrl"], vin=v["VehicleVin"], stockId=v["VehicleStockNumber"], mileage=v["Mileage"], price=price, images=F.filter(F.array(image), lambda i: i != ""))


def dealer_sync(payloads: DataFrame) -> DataFrame:
    """Vehicles once by number or stock; the final price, else the internet price."""
    rows, v = _rows(payloads, DEALER_SYNC, "Vehicles"), F.col("v")
    rows = once(rows, F.upper(first_filled(v["Vin"], v["StockNo"])))
    price = F.when(v["FinalPrice"] > 0, v["FinalPrice"]).otherwise(v["InternetPrice"])
    image = rooted(F.col("source_url"), text.trim(F.coalesce(v["FirstImageUrl"], F.lit(""))))
    return _item(rows, title=first_filled(v["VehicleTitle"], v["VehicleName"], joined(v["Year"], v["Make"], v["Model"], v["Trim"])), url=rooted(F.col("source_url"), text.trim(F.coalesce(v["VehicleDetailUrl"], F.lit("")))), vin=text.trim(F.coalesce(v["Vin"], F.lit(""))), stockId=text.trim(F.coalesce(v["StockNo"], F.lit(""))), mileage=positive(v["Mileage"]), price=F.when(price > 0, F.concat(F.lit("$"), whole(price))), images=F.filter(F.array(image), lambda i: i != ""))


def driven_motion(payloads: DataFrame, dealer_id: int | Column, *carried: str) -> DataFrame:
    """One store's active retail vehicles, once by number or stock; ``carried`` names columns that ``dealer_id`` is made of."""
    rows, v = _rows(payloads, DRIVEN_MOTION, "props.pageProps.inventory.results", *carried), F.col("v")
    store = F.coalesce(v["dealer_id"], F.lit(0))
    rows = rows.where(((store == 0) | (store == dealer_id)) & (blank(v["status"]) | (F.lower(v["status"]) == "active")) & (F.coalesce(v["wholesale"], F.lit(0)) == 0))
    rows = once(rows, F.upper(first_filled(v["vin"], v["stocknumber"])))
    return _item(rows, title=joined(v["year"], v["make"], v["model"], v["trim"]), url=rooted(F.col("source_url"), v["url"]), vin=identity.valid_vin(F.coalesce(v["vin"], F.lit(""))), stockId=v["stocknumber"], year=v["year"], make=v["make"], model=v["model"], price=whole(v["price"]), mileage=whole(v["mileage"]), images=filled(v["photos"]), color=v["exteriorcolor"], bodyType=v["body"], fuelType=v["fuel"], driveType=v["drivetrainstandard"])


def horne_motors(payloads: DataFrame) -> DataFrame:
    """Available vehicles; the detail path is the slugs of year, make, model, trim and stock."""
    rows, v = _rows(payloads, HORNE, "vehicles"), F.col("v")
    rows = rows.where(blank(v["status"]) | (F.lower(v["status"]) == "available"))
    slugs = F.filter(F.transform(F.array(v["year"].cast("string"), v["make"], v["model"], v["trim"], v["stockNumber"]), lambda s: text.slug(F.coalesce(s, F.lit("")))), lambda s: s != "")
    images = F.transform(filled(F.transform(v["photos"], lambda p: p["url"])), lambda p: rooted(F.col("source_url"), p))
    return _item(rows, title=joined(v["year"], v["make"], v["model"], v["trim"]), url=F.concat(F.lit("/inventory/"), F.array_join(slugs, "-")), vin=identity.valid_vin(F.coalesce(v["vin"], F.lit(""))), stockId=v["stockNumber"], year=v["year"], make=v["make"], model=v["model"], price=whole(v["hornePrice"]), mileage=whole(v["mileage"]), images=images, color=v["exteriorColor"], driveType=v["drivetrain"], transmission=v["transmission"], engine=v["engineDescription"], bodyType=v["bodyClass"], fuelType=v["fuelType"])


def imotor(payloads: DataFrame) -> DataFrame:
    """Trucks with an id, which is their stock number; the detail path is a template of it."""
    parsed = payloads.select("run_id", "source_url", "page_seq", F.from_json("payload", IMOTOR).alias("j"))
    rows, v = parsed.select("run_id", "source_url", "page_seq", F.posexplode(F.get("j.results", F.lit(0))["hits"]).alias("pos", "v")).where("v.id > 0"), F.col("v")
    kind = text.slug(first_filled(v["vehType"], F.lit("used")))
    url = F.concat(F.lit("/"), kind, F.lit("-trucks/for-sale/"), text.slug(F.coalesce(v["make"], F.lit(""))), F.lit("/"), text.slug(F.coalesce(v["model"], F.lit(""))), F.lit("/"), v["year"].cast("string"), F.lit("/"), v["id"].cast("string"), F.lit("/"))
    return _item(rows, title=joined(v["year"], v["make"], v["model"]), url=url, vin=identity.valid_vin(F.coalesce(v["vin"], F.lit(""))), stockId=v["id"], year=v["year"], make=v["make"], model=v["model"], price=whole(v["price"]), mileage=whole(v["odometer"]), images=filled(v["images"]))


def space_auto(payloads: DataFrame, links: DataFrame) -> DataFrame:
    """Vehicles with a title; the discounted price if positive; URLs joined from (vin, url, pos), the last of a vin, and of
    its run and source where ``links`` has them."""
    rows, v = _rows(payloads, SPACE_AUTO, "vehicles"), F.col("v")
    own = [c for c in ("run_id", "source_url") if c in links.columns]
    known = links.groupBy(*own, F.upper("vin").alias("_vin")).agg(F.max_by("url", "pos").alias("_url"))
    rows = rows.withColumn("_vin", F.upper(v["vin"])).join(known, [*own, "_vin"], "left")
    title = joined(positive(v["year"]), v["make"], v["model"], v["trim"])
    price = F.when(v["discountedPrice"] > 0, v["discountedPrice"]).otherwise(v["price"])
    url = F.coalesce(F.nullif("_url", F.lit("")), F.concat(F.lit("/vehicle/"), F.lower(v["vin"]), F.lit("/")))
    return _item(rows.where(title != ""), title=title, url=url, vin=identity.valid_vin(F.coalesce(v["vin"], F.lit(""))), stockId=v["stock"], year=positive(v["year"]), make=v["make"], model=v["model"], price=money(price), mileage=grouped(v["mileage"]), images=filled(v["photos"]), color=v["color"], bodyType=v["body"], driveType=v["driveline"], fuelType=v["fuel"], engine=v["engine"], transmission=v["transmission"], cylinders=positive(v["engineCylinderCount"]), cityMPG=F.when(v["cityMPG"] > 0, whole(v["cityMPG"])), highwayMPG=F.when(v["highwayMPG"] > 0, whole(v["highwayMPG"])))
