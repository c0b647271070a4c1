"""Queries over pages and responses made from the part table, with braces in strings, unclosed objects and the like, and
the SQL that gives the same rows from the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import captures, details, discover, embedded, extract, ingest, page_links, paginate, platforms, refine, schedule, strict
from ..sources import images
from ..streaming import events
from .catalog import query
from .samples import table

#: SQL by query name.
SQL: dict[str, str] = {}

#: Parts of a made page.
PAGE_PARTS = 25


def _c(name: str) -> Column:
    return F.col(name)


def _text(c: Column | str) -> Column:
    return (_c(c) if isinstance(c, str) else c).cast("string")


def _lists(spark: SparkSession, sf_dir: str, vehicle: Column, by: Column) -> DataFrame:
    """``k`` and ``list``: the parts of each page as structs, in order of their keys."""
    parts = table(spark, sf_dir, "part").withColumn("k", by).withColumn("v", vehicle)
    return parts.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "v"))), lambda x: x["v"]).alias("list"))


def _number(k: str = "p_partkey") -> Column:
    return F.concat(F.lit("1HGCM82633A"), F.lpad(_text(_c(k) % 1_000_000), 6, "0"))


def _shown(items: DataFrame, *columns: str) -> DataFrame:
    return items.select("source_url", "pos", *columns, F.array_join("images", ",").alias("images"))


PAGE_OF_PART = f"(p_partkey // {PAGE_PARTS})"
NUMBER_SQL = "'1HGCM82633A' || lpad((p_partkey % 1000000)::VARCHAR, 6, '0')"
PLACE_SQL = f"(row_number() OVER (PARTITION BY {PAGE_OF_PART} ORDER BY p_partkey) - 1)::INT"


def _state_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the listing's state in a script: braces, quotes and backslashes in titles, objects that never close, pages
    without a state, and pages with a second one."""
    p, attribute = _c("p_partkey"), lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    price = F.concat(F.lit("$"), _text(F.floor("p_retailprice")))
    vehicle = F.struct(
        _number().alias("vin"), F.concat(F.lit("S"), _text(p)).alias("stockNumber"), (1990 + _c("p_size")).alias("year"), F.concat(F.lit("A&amp;"), "p_brand").alias("make"), _c("p_type").alias("model"), F.lit("LX").alias("trim"),
        F.when(p % 3 == 0, F.array("p_brand", F.concat("p_type", F.lit(' {"x"} \\ }')))).otherwise(F.array().cast("array<string>")).alias("title"), F.concat(F.lit("/car/"), _text(p)).alias("link"), F.lit("SUV").alias("bodyStyle"),
        F.transform(F.sequence(F.lit(0), (p % 3).cast("int")), lambda i: F.struct(F.when(i > 0, F.concat(F.lit("/i/"), _text(p), F.lit("-"), i.cast("string"), F.lit(".jpg"))).otherwise("").alias("uri"))).alias("images"),
        F.struct(F.when(p % 2 == 1, price).alias("retailPrice"), F.array(F.struct(F.lit("$1").alias("value"), F.lit(False).alias("isFinalPrice")), F.struct(F.when(p % 2 == 0, price).otherwise(" ").alias("value"), F.lit(True).alias("isFinalPrice"))).alias("dprice")).alias("pricing"),
        F.when(p % 4 == 1, F.array(attribute("ODOMETER", F.lit("77 mi.")))).otherwise(none).alias("attributes"), F.when(p % 4 <= 1, F.array(attribute("odometer", F.lit("1,234 Miles")), attribute("driveLine", F.lit("AWD")))).otherwise(none).alias("trackingAttributes"),
        F.array(attribute("exteriorColor", F.lit(" Blue ")), attribute("normalDriveLine", F.when(p % 8 == 0, "4x4").otherwise(""))).alias("highlightedAttributes"),
    )
    k, size = _c("k"), F.size("list")
    state = lambda vehicles: F.to_json(F.struct(F.struct(F.struct((k * 3).alias("totalCount"), size.alias("pageSize"), (k % 10).alias("pageStart")).alias("pageInfo"), vehicles.alias("inventory")).alias("WIS")))
    mark = lambda bus: F.lit(f"DDC.WS.state['ws-inv-data'][\"inventory-data-{bus}\"] = ")
    whole = state(_c("list"))
    script = F.when(k % 5 == 1, F.concat(mark("bus1"), F.expr("left(json, length(json) - 2)"))).when(k % 5 == 2, F.lit("var other = {};")).when(k % 5 == 3, F.concat(mark("bus1"), "json", F.lit(";\n"), mark("bus2"), F.lit('{"WIS":{"inventory":[]}}'))).otherwise(F.concat(mark("bus1"), "json"))
    html = F.concat(F.lit('<html><script>var a = "{";'), script, F.lit(';</script><p>"}" {</p></html>'))
    made = _lists(spark, sf_dir, vehicle, F.expr(f"p_partkey div {PAGE_PARTS}")).withColumn("json", whole)
    return made.select(F.lit("r").alias("run_id"), k.cast("int").alias("page_seq"), F.concat(F.lit("https://d.example/used/?k="), _text(k)).alias("url"), html.alias("html"))


@query
def platform_dealer_dot_com(spark, sf_dir):
    """Vehicles of the state in the pages' scripts."""
    return _shown(embedded.dealer_dot_com(_state_pages(spark, sf_dir)), "title", "url", "vin", "stockId", "year", "make", "model", "price", "mileage", "bodyType", "color", "driveType", "primaryImage")


SQL["platform_dealer_dot_com"] = f"""WITH p AS (SELECT *, {PAGE_OF_PART} AS k, {PLACE_SQL} AS pos, (1990 + p_size)::VARCHAR AS year, 'A&' || p_brand AS make, '$' || floor(p_retailprice)::BIGINT AS price, '/i/' || p_partkey || '-' AS i FROM part)
  SELECT 'https://d.example/used/?k=' || k AS source_url, pos, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || p_type || ' {{"x"}} \\ }}' ELSE year || ' ' || make || ' ' || p_type || ' LX' END AS title, '/car/' || p_partkey AS url, {NUMBER_SQL} AS vin,
    'S' || p_partkey AS "stockId", year, make, p_type AS model, price, CASE p_partkey % 4 WHEN 1 THEN '77' WHEN 0 THEN '1,234' ELSE '' END AS mileage, 'SUV' AS "bodyType", 'Blue' AS color,
    CASE WHEN p_partkey % 8 = 0 THEN '4x4' WHEN p_partkey % 4 <= 1 THEN 'AWD' ELSE '' END AS "driveType", CASE WHEN p_partkey % 3 > 0 THEN i || '1.jpg' ELSE '' END AS "primaryImage",
    CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN i || '1.jpg' ELSE i || '1.jpg,' || i || '2.jpg' END AS images FROM p WHERE k % 5 NOT IN (1, 2)"""


@query
def dealer_dot_com_paging(spark, sf_dir):
    """What each state says of its listing, and the first and last of the other pages."""
    found = embedded.dealer_dot_com_paging(_state_pages(spark, sf_dir))
    return found.select("page_seq", "total", "size", "start", F.size("further").alias("pages"), F.coalesce(F.get("further", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get("further", F.size("further") - 1), F.lit("")).alias("last"))


SQL["dealer_dot_com_paging"] = f"""WITH p AS (SELECT {PAGE_OF_PART} AS k, count(*) AS size FROM part GROUP BY 1 HAVING k % 5 NOT IN (1, 2)), n AS (SELECT *, CASE WHEN k * 3 > size THEN least(ceil(k * 3 / size)::INT, 120) - 1 ELSE 0 END AS pages FROM p)
  SELECT k::INT AS page_seq, (k * 3)::INT AS total, size::INT AS size, (k % 10)::INT AS start, pages::INT AS pages, CASE WHEN pages > 0 THEN 'https://d.example/used/?k=' || k || '&start=' || size ELSE '' END AS first,
    CASE WHEN pages > 0 THEN 'https://d.example/used/?k=' || k || '&start=' || size * pages ELSE '' END AS last FROM n"""


@query
def platform_space_auto_pages(spark, sf_dir):
    """Vehicles of a search's responses, joined with the link scripts that the pages name: the last link of a number counts,
    lists that do not parse and scripts of other hosts do not, and pages without the platform's marks give no rows."""
    p, k = _c("p_partkey"), _c("k")
    vehicle = F.struct(F.when(p % 2 == 0, _number()).otherwise(F.lower(_number())).alias("vin"), _c("p_brand").alias("make"), F.floor("p_retailprice").cast("double").alias("price"), F.when(p % 5 == 0, F.lit(1000.0)).alias("discountedPrice"), (p * 7).cast("double").alias("mileage"), F.array(F.concat(F.lit("/i/"), _text(p))).alias("photos"), (p % 3).alias("engineCylinderCount"))
    lists = _lists(spark, sf_dir, vehicle, F.expr(f"p_partkey div {PAGE_PARTS}"))
    source = F.concat(F.lit("https://s"), _text(k), F.lit(".example/cars"))
    script = F.concat(F.lit("https://"), F.when(k % 4 == 2, "cdn").otherwise(F.concat(F.lit("S"), _text(k), F.lit(".EXAMPLE"))), F.lit("/space/vehicles.js?v="), _text(k))
    html = F.concat(F.when(k % 7 == 3, "").otherwise("<i>space-auto.com</i>"), F.lit("<script>$space_id = 'ab_1';</script><script src=\""), script, F.lit('"></script>'))
    pages = lists.select(F.lit("r").alias("run_id"), F.lit(1).alias("page_seq"), source.alias("url"), html.alias("html"))
    responses = lists.select(F.lit("r").alias("run_id"), source.alias("source_url"), F.lit(1).alias("page_seq"), F.to_json(F.struct(F.size("list").alias("total"), _c("list").alias("vehicles"))).alias("payload"))
    entry = lambda kind: F.struct(F.concat(F.lit(f"/car/{kind}"), _text(p)).alias("url"), F.lower(_number()).alias("vin"))
    entries = F.array_compact(F.array(F.when(p % 3 == 0, entry("a")), F.when(p % 6 == 0, entry("b")), F.struct(F.lit("").alias("url"), _number().alias("vin"))))
    links = _lists(spark, sf_dir, entries, F.expr(f"p_partkey div {PAGE_PARTS}"))
    body = F.concat(F.lit("var x = 1; var space_vehicles_json = "), F.to_json(F.flatten("list")), F.when(k % 4 == 1, ",]").otherwise(""), F.lit(" ; var y = [];"))
    scripts = links.select(script.alias("url"), F.when(k % 4 == 1, F.replace(body, F.lit("}]"), F.lit("}"))).otherwise(body).alias("body"))
    return _shown(embedded.space_auto(pages, responses, scripts), "title", "url", "vin", "price", "mileage", "cylinders")


SQL["platform_space_auto_pages"] = f"""WITH p AS (SELECT *, {PAGE_OF_PART} AS k, {PLACE_SQL} AS pos, {NUMBER_SQL} AS n FROM part)
  SELECT 'https://s' || k || '.example/cars' AS source_url, pos, p_brand AS title, CASE WHEN k % 4 IN (1, 2) OR p_partkey % 3 > 0 THEN '/vehicle/' || lower(n) || '/' WHEN p_partkey % 6 = 0 THEN '/car/b' || p_partkey ELSE '/car/a' || p_partkey END AS url, n AS vin,
    '$' || CASE WHEN p_partkey % 5 = 0 THEN '1,000' ELSE format('{{:,}}', floor(p_retailprice)::BIGINT) END AS price, CASE WHEN p_partkey > 0 THEN format('{{:,}}', p_partkey * 7) ELSE '' END AS mileage, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 3)::VARCHAR ELSE '' END AS cylinders, '/i/' || p_partkey AS images
  FROM p WHERE k % 7 <> 3"""


@query
def bounded_search(spark, sf_dir):
    """How many responses of a search of a stated size and pages of 25 are read."""
    k = _c("k")
    lists = _lists(spark, sf_dir, F.struct(_number().alias("vin")), F.expr(f"p_partkey div {PAGE_PARTS}"))
    kept = F.when(k % 11 == 5, F.slice("list", 1, 7)).when(k % 13 == 6, F.slice("list", 1, 0)).otherwise(_c("list"))
    total = F.when(k % 3 == 0, 0).otherwise(100)
    run = F.expr("k div 8")
    responses = lists.select(run.alias("run_id"), F.lit("u").alias("source_url"), k.alias("page_seq"), F.to_json(F.struct(F.when(run % 3 == 0, 0).otherwise(100).alias("total"), kept.alias("vehicles"))).alias("payload"), total.alias("_t"))
    return embedded.bounded_responses(responses.drop("_t"), 25, 150).groupBy("run_id").agg(F.count("*").alias("responses"), F.max("page_seq").alias("last"))


SQL["bounded_search"] = f"""WITH l AS (SELECT {PAGE_OF_PART} AS k, count(*) AS c FROM part GROUP BY 1), r AS (SELECT k, k // 8 AS run_id, CASE WHEN k % 11 = 5 THEN least(c, 7) WHEN k % 13 = 6 THEN 0 ELSE c END AS n, CASE WHEN (k // 8) % 3 = 0 THEN 0 ELSE 100 END AS total FROM l),
  s AS (SELECT *, n < 25 OR (total > 0 AND sum(n) OVER w >= total) AS ends, (row_number() OVER w - 1) * 25 AS start FROM r WINDOW w AS (PARTITION BY run_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM s) SELECT run_id, count(*) AS responses, max(k) AS last FROM e WHERE NOT over AND n > 0 AND start < 150 GROUP BY run_id"""


@query
def platform_driven_motion(spark, sf_dir):
    """One store's vehicles from the pages' data scripts: other stores', sold and wholesale ones go, repeats count once."""
    p, k = _c("p_partkey"), _c("k")
    vehicle = F.struct(_number().alias("vin"), F.concat(F.lit("S"), _text(p)).alias("stocknumber"), (1990 + _c("p_size")).alias("year"), _c("p_brand").alias("make"), F.lit("M").alias("model"), F.lit(" ").alias("trim"), (F.floor("p_retailprice") + 0.75).alias("price"), (p % 4).alias("dealer_id"), F.when(p % 7 == 0, "Sold").when(p % 7 == 1, "ACTIVE").otherwise("").alias("status"), F.when(p % 11 == 0, 1).otherwise(0).alias("wholesale"), F.concat(F.lit("/v/"), _text(p)).alias("url"), F.array(F.lit(""), F.lit("/i")).alias("photos"))
    lists = _lists(spark, sf_dir, vehicle, F.expr(f"p_partkey div {PAGE_PARTS}"))
    url = F.concat(F.lit("https://M.example/Inventory/".replace("I", "i")), F.when(k % 3 == 0, "North/").when(k % 3 == 1, "south").otherwise("nowhere"))
    json = F.to_json(F.struct(F.struct(F.struct(F.struct(F.concat("list", F.slice("list", 1, 2)).alias("results")).alias("inventory")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), json, F.when(k % 5 == 0, "").otherwise("</script><p></p>"))
    pages = lists.select(_text(k).alias("run_id"), F.lit(1).alias("page_seq"), url.alias("url"), html.alias("html"))
    stores = spark.createDataFrame([("north", 1), ("south", 2)], "slug string, dealer_id int")
    return embedded.driven_motion(pages, stores).select("run_id", "title", "url", "vin", "stockId", "year", "make", "price", F.array_join("images", ",").alias("images"))


SQL["platform_driven_motion"] = f"""SELECT {PAGE_OF_PART}::VARCHAR AS run_id, (1990 + p_size) || ' ' || p_brand || ' M' AS title, 'https://M.example/v/' || p_partkey AS url, {NUMBER_SQL} AS vin, 'S' || p_partkey AS "stockId", (1990 + p_size)::VARCHAR AS year, p_brand AS make, (floor(p_retailprice)::BIGINT + 1)::VARCHAR AS price, '/i' AS images
  FROM part WHERE {PAGE_OF_PART} % 3 < 2 AND {PAGE_OF_PART} % 5 <> 0 AND p_partkey % 4 IN (0, {PAGE_OF_PART} % 3 + 1) AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"""


def _payloads(lists: DataFrame, body: Column) -> DataFrame:
    """Two responses of each listing, the second repeating the first."""
    every = F.explode(F.sequence(F.lit(1), F.lit(2)))
    return lists.select(_text("k").alias("run_id"), F.concat(F.lit("https://w.example/l"), _text("k")).alias("source_url"), every.alias("page_seq"), F.to_json(body).alias("payload"))


@query
def platform_dealer_on(spark, sf_dir):
    """Vehicles once by number, priced by the internet price or by the pricing panel's text, where the page shows the platform's marks."""
    p, k, price = _c("p_partkey"), _c("k"), _text(F.floor("p_retailprice"))
    panel = F.when(p % 4 == 1, F.concat(F.lit("<b>MSRP Price:</b> $9,999 <i>Our price</i>: $"), price)).when(p % 4 == 2, F.concat(F.lit("$"), price, F.lit(" SALE PRICE"))).when(p % 4 == 3, F.lit("<p>Suggested Price -$1,234</p>"))
    deep = F.struct(F.struct(F.struct(panel.alias("BuyContent")).alias("PriceStakTabsModel")).alias("PriceStakViewModel"))
    car = F.struct(_number().alias("VehicleVin"), (1990 + _c("p_size")).alias("VehicleYear"), _c("p_brand").alias("VehicleMake"), _c("p_type").alias("VehicleModel"), F.concat(F.lit("S"), _text(p)).alias("VehicleStockNumber"), _text(p * 3).alias("Mileage"), F.when(p % 4 == 0, F.floor("p_retailprice").cast("double")).otherwise(0.0).alias("VehicleInternetPrice"), F.concat(F.lit("/d/"), _text(p)).alias("VehicleDetailUrl"), F.struct(F.when(p % 2 == 0, F.concat(F.lit("//c.example/"), _text(p))).otherwise("/i.jpg").alias("VehiclePhotoSrc")).alias("VehicleImageModel"), deep.alias("WasabiVehiclePricingPanelViewModel"))
    lists = _lists(spark, sf_dir, F.struct(car.alias("VehicleCard")), F.expr(f"p_partkey div {PAGE_PARTS}"))
    responses = _payloads(lists, F.struct(_c("list").alias("DisplayCards")))
    html = F.concat(F.lit("dealeron_tagging_data "), F.when(k % 4 == 2, "").otherwise("/api/vhcliaa/"), F.lit(' {"dealerId": "12", "pageId": 34}'))
    pages = lists.select(_text(k).alias("run_id"), F.lit(1).alias("page_seq"), F.concat(F.lit("https://w.example/l"), _text(k)).alias("url"), html.alias("html"))
    return embedded.dealer_on(pages, responses).select("run_id", "title", "url", "vin", "stockId", "mileage", "price", "primaryImage")


SQL["platform_dealer_on"] = f"""SELECT {PAGE_OF_PART}::VARCHAR AS run_id, (1990 + p_size) || ' ' || p_brand || ' ' || p_type AS title, '/d/' || p_partkey AS url, {NUMBER_SQL} AS vin, 'S' || p_partkey AS "stockId", (p_partkey * 3)::VARCHAR AS mileage,
  '$' || CASE WHEN p_partkey % 4 = 3 THEN '1,234' ELSE floor(p_retailprice)::BIGINT::VARCHAR END AS price, CASE WHEN p_partkey % 2 = 0 THEN 'https://c.example/' || p_partkey ELSE 'https://w.example/i.jpg' END AS "primaryImage" FROM part WHERE {PAGE_OF_PART} % 4 <> 2"""


@query
def platform_horne_motors(spark, sf_dir):
    """Available vehicles with detail paths of slugs."""
    p = _c("p_partkey")
    photo = lambda u: F.struct(u.alias("url"))
    car = F.struct(_number().alias("vin"), F.concat(F.lit("61-"), _text(p)).alias("stockNumber"), (1990 + _c("p_size")).alias("year"), F.lit("Land Rover").alias("make"), _c("p_brand").alias("model"), F.when(p % 2 == 0, "S/E  +").otherwise("").alias("trim"), (F.floor("p_retailprice") + 0.25).alias("hornePrice"), (p * 2).cast("double").alias("mileage"), F.when(p % 5 == 0, "sold").when(p % 5 == 1, "Available").alias("status"), F.lit("Red").alias("exteriorColor"), F.array(photo(F.lit("/p/1")), photo(F.lit(" ")), photo(F.concat(F.lit("https://c.example/"), _text(p)))).alias("photos"))
    lists = _lists(spark, sf_dir, car, F.expr(f"p_partkey div {PAGE_PARTS}"))
    items = platforms.horne_motors(_payloads(lists, F.struct(_c("list").alias("vehicles"))).where("page_seq = 1"))
    return _shown(items, "title", "url", "vin", "stockId", "price", "mileage", "color")


SQL["platform_horne_motors"] = f"""WITH p AS (SELECT *, {PAGE_OF_PART} AS k, {PLACE_SQL} AS pos, CASE WHEN p_partkey % 2 = 0 THEN ' S/E  +' ELSE '' END AS t, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM part)
  SELECT 'https://w.example/l' || k AS source_url, pos, (1990 + p_size) || ' Land Rover ' || p_brand || t AS title, '/inventory/' || (1990 + p_size) || '-land-rover-' || b || CASE WHEN p_partkey % 2 = 0 THEN '-s-e' ELSE '' END || '-61-' || p_partkey AS url, {NUMBER_SQL} AS vin, '61-' || p_partkey AS "stockId",
    floor(p_retailprice)::BIGINT::VARCHAR AS price, (p_partkey * 2)::VARCHAR AS mileage, 'Red' AS color, 'https://w.example/p/1,https://c.example/' || p_partkey AS images FROM p WHERE p_partkey % 5 <> 0"""


def _walked(spark: SparkSession, sf_dir: str) -> paginate.Walk:
    """Customers as runs, their orders as numbered pages: page n links 2n + 1, 2n and 3n + 1. Some pages have no cards, some
    are not the one asked for, some are not landed; six pages a run."""
    n, c = _c("n"), _text("o_custkey")
    orders = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumn("m", F.count("*").over(Window.partitionBy("o_custkey")))
    base = F.concat(F.lit("https://c"), c, F.lit(".example/inventory?page="))
    link = lambda to: F.when(to <= _c("m"), F.concat(F.lit('<a class="x-next" href="?page='), _text(to), F.lit('">n</a>'))).otherwise("")
    html = F.concat(F.when((n > 1) & (n % 7 == 3), "").otherwise('<div class="card"></div>'), F.lit('<div class="pager">'), F.when((n > 1) & (n % 5 == 0), "Page 1 of 9").otherwise(""), F.lit("</div>"), link(2 * n + 1), link(2 * n), link(3 * n + 1))
    pages = orders.where("n = 1 or n % 11 <> 10").select(F.concat(base, _text(n)).alias("url"), html.alias("html"))
    starts = orders.where("n = 1").select(c.alias("run_id"), F.concat(base, F.lit("1")).alias("url"))
    return page_links.collect(pages, starts, {"cardSelector": ".card", "pagination": {"maxPages": 6}})


_WALK_SQL = """WITH RECURSIVE o AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
  g AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN n % 11 = 10 THEN 'page not landed' WHEN n % 7 = 3 THEN 'pagination page returned zero inventory cards' WHEN n % 5 = 0 THEN 'requested page ' || n || ' but got page 1' END AS message FROM o),
  e AS (SELECT c, n, 0 AS place, 2 * n + 1 AS child FROM g UNION ALL SELECT c, n, (2 * n + 1 <= m)::INT, 2 * n FROM g UNION ALL SELECT c, n, (2 * n + 1 <= m)::INT + (2 * n <= m)::INT, 3 * n + 1 FROM g),
  l AS (SELECT e.c, e.n, place, child, message FROM e JOIN g ON g.c = e.c AND g.n = child),
  w AS (SELECT c, n, 0::BIGINT AS parent, 0 AS depth, []::INT[] AS path FROM g WHERE n = 1 UNION ALL SELECT l.c, child, l.n, depth + 1, list_append(path, place) FROM w JOIN l ON l.c = w.c AND l.n = w.n WHERE message IS NULL),
  f AS (SELECT c, n, min({'d': depth, 'p': path}) AS way, arg_min(parent, {'d': depth, 'p': path}) AS parent FROM w GROUP BY c, n), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY way) AS seq FROM f) WHERE seq <= 6)"""
SQL["paging_walk"] = _WALK_SQL + " SELECT c::VARCHAR AS run_id, seq::INT AS page_seq, 'https://c' || c || '.example/inventory?page=' || n AS url FROM a"
SQL["paging_refused"] = _WALK_SQL + """, x AS (SELECT a.c, b.seq AS seq, list_last(a.way.p) AS place FROM a JOIN a b ON a.c = b.c AND a.parent = b.n WHERE a.seq = 6)
  SELECT l.c::VARCHAR AS run_id, 'https://c' || l.c || '.example/inventory?page=' || child AS url, message, a.seq::INT AS parent_seq, l.place::INT AS place FROM l JOIN a ON a.c = l.c AND a.n = l.n LEFT JOIN x ON x.c = l.c WHERE message IS NOT NULL AND (x.c IS NULL OR (a.seq, l.place) < (x.seq, x.place))"""


@query
def paging_walk(spark, sf_dir):
    """Pages in the order in which a queue finds them."""
    return _walked(spark, sf_dir).pages


@query
def paging_refused(spark, sf_dir):
    """Pages that are refused on the way, and why."""
    return _walked(spark, sf_dir).refused.select("run_id", "url", "message", "parent_seq", "place")


@query
def paging_links(spark, sf_dir):
    """Further pages under each kind of pager, in order."""
    p, n = _c("p_partkey"), _c("p_size") % 7
    kind = p % 6
    given = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else _text(x) for x in parts])
    html = (
        F.when(kind == 0, given('<ul dealr-pagination="', n, '"></ul>')).when(kind == 1, given('<div class="x-pager-summary">Page: 2 of ', n, "</div>")).when(kind == 2, given('<div class="x-pagination">PrevPage 1 of ', n, "Next</div>"))
        .when(kind == 3, given('<b class="pagination_settings__page_count"> ', n, ' </b><input class="pagination_settings__input" value="2">')).when(kind == 4, given('<div data-role="pager">Showing 1 - 10 of ', n * 10 - 3, " Results</div>"))
        .otherwise(given('<div class="pager"><a href="?a=1&amp;page=2">2</a><a href="?a=1&amp;page=', n + 3, '">last</a></div>'))
    )
    pages = table(spark, sf_dir, "part").select(given("https://p", p, ".example/inventory?a=1").alias("url"), html.alias("html"))
    return page_links.page_links(page_links.features(pages, {}))


SQL["paging_links"] = """WITH p AS (SELECT p_partkey % 6 AS kind, p_size % 7 AS n, 'https://p' || p_partkey || '.example/inventory?' AS u FROM part),
  k AS (SELECT kind, u, CASE kind WHEN 5 THEN [2, n + 3] || range(3, n + 3) WHEN 1 THEN range(3, n + 1) WHEN 3 THEN range(3, n + 1) ELSE range(2, n + 1) END AS pages FROM p), f AS (SELECT kind, u, unnest(pages) AS page, generate_subscripts(pages, 1) - 1 AS place FROM k)
  SELECT u || 'a=1' AS url, place::INT AS place, u || CASE kind WHEN 2 THEN 'PageNumber=' || page || '&PageSize=100&a=1' WHEN 3 THEN 'a=1&p=' || page WHEN 4 THEN 'Paging.Page=' || page || '&a=1' ELSE 'a=1&page=' || page END AS next_url FROM f"""


@query
def section_union(spark, sf_dir):
    """Orders as runs, their lines as cards of two sections, read until a page adds nothing new."""
    line = table(spark, sf_dir, "lineitem")
    cards = line.select("l_orderkey", F.when(_c("l_suppkey") % 2 == 0, "new").otherwise("used").alias("section"), F.expr("cast(1 + l_linenumber div 2 as int)").alias("page"), _c("l_linenumber").alias("pos"), F.when(_c("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" /Viewdetails/"), _text(_c("l_partkey") % 5))).alias("key"))
    return paginate.first_added(cards, ["l_orderkey"], ["new", "used"], 3).select("l_orderkey", "section", "page", "pos", F.trim("key").alias("key"))


def _section_sql() -> str:
    """A section's keys that the sections before do not have, their first places, and the prefix of pages that each add."""
    part = lambda name, own, before: f"""{name}f AS (SELECT o, key, min((page, pos)) AS spot FROM c WHERE section = '{own}' AND page <= 3 AND key <> '' {before} GROUP BY o, key), {name}a AS (SELECT o, spot[1] AS page FROM {name}f GROUP BY ALL),
      {name}r AS (SELECT o, max(page) AS last FROM (SELECT o, page, row_number() OVER (PARTITION BY o ORDER BY page) AS nth FROM {name}a) WHERE nth = page GROUP BY o), {name} AS (SELECT o, '{own}' AS section, spot[1] AS page, spot[2] AS pos, key FROM {name}f JOIN {name}r USING (o) WHERE spot[1] <= last)"""  # noqa: E731
    return f"""WITH c AS (SELECT l_orderkey AS o, CASE WHEN l_suppkey % 2 = 0 THEN 'new' ELSE 'used' END AS section, 1 + l_linenumber // 2 AS page, l_linenumber AS pos, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE '/viewdetails/' || l_partkey % 5 END AS key FROM lineitem),
      {part("n", "new", "")}, {part("u", "used", "AND (o, key) NOT IN (SELECT o, key FROM n)")} SELECT o AS l_orderkey, section, page::INT AS page, pos, replace(key, '/v', '/V') AS key FROM (FROM n UNION ALL FROM u)"""


SQL["section_union"] = _section_sql()


def _image_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of their own sizes: PNG, GIF and JPEG with segments before the frame, some of them cut, and no images."""
    p = _c("p_partkey")
    w, h = (p % 1000 + 1).cast("int"), (_c("p_size") * 12).cast("int")
    big, little = (lambda c, n: F.lpad(F.hex(c), 2 * n, "0")), (lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0")))
    head = F.concat(F.lit("49484452"), big(w, 4), big(h, 4), F.lit("0802000000"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), head, big(F.crc32(F.unhex(head)), 4), F.lit("00000000"))
    gif = F.concat(F.lit("474946383961"), little(w), little(h), F.lit("800000"), F.lit("00" * 6), F.lit("3B"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600" + "00" * 9), F.lit("FFFE"), big((p % 50) + 2, 2), F.repeat(F.lit("FF"), (p % 50).cast("int")), F.lit("FFFFC2001108"), big(h, 2), big(w, 2), F.lit("03" + "012200" * 3))
    whole = F.when(p % 4 == 0, png).when(p % 4 == 1, gif).when(p % 4 == 2, jpeg).otherwise(F.lit("3C737667"))
    cut = F.when(p % 7 == 3, F.substring(whole, 1, 40)).otherwise(whole)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("https://v.example/i/"), _text(p)).alias("url"), F.unhex(cut).alias("content"))


@query
def image_sizes(spark, sf_dir):
    return images.sizes(_image_bytes(spark, sf_dir))


SQL["image_sizes"] = "SELECT 'https://v.example/i/' || p_partkey AS url, p_partkey % 1000 + 1 AS w, (p_size * 12)::BIGINT AS h FROM part WHERE p_partkey % 4 < 3 AND (p_partkey % 7 <> 3 OR p_partkey % 4 = 1)"


@query
def detail_fields(spark, sf_dir):
    """Parts as items whose blank fields their detail pages fill, and whose images are those that are not known to be small."""
    p = _c("p_partkey")
    url = F.concat(F.lit("https://v.example/d/"), _text(p))
    row = lambda label, value: F.concat(F.lit(f"<tr><td>{label}</td><td>"), value, F.lit("</td></tr>"))
    image = lambda k, more="": F.concat(F.lit('<img class="g" src="/i/'), _text(p + k), F.lit(f'"{more}>'))
    html = F.concat(
        F.lit("<script>Year: 1900</script><table>"), row("Stock #", F.concat(F.lit("K"), _text(p))), row("Year", _text(1990 + _c("p_size"))), row("Drivetrain", F.lit("AWD")), row("Fuel Type", F.when(p % 3 == 0, "").otherwise("Gas")), F.lit("</table>"),
        F.when(p % 2 == 0, F.lit('<div><div class="vdp-info-block__info-item-title">Engine</div><div></div><div class="vdp-info-block__info-item-description">3.6L V6</div></div>')).otherwise(""),
        image(0), image(1, ' width="640" height="480"'), image(2, ' data-height="299"'), image(4),
    )
    parts = table(spark, sf_dir, "part")
    given = {"url": url, "engine": F.lit("old"), "stockId": F.when(p % 5 == 0, F.concat(F.lit("own"), _text(p))).otherwise("")}
    items = parts.select(p.alias("id"), *[given.get(n, F.lit("")).alias(n) for n in schemas.ITEM_TEXTS], F.array(F.lit("/card.jpg")).alias("images"))
    pages = parts.where("p_partkey % 11 <> 4").select(url.alias("url"), html.alias("html"))
    found = details.enrich(items, pages, {"imageSelector": "img.g"}, images.sizes(_image_bytes(spark, sf_dir)))
    return found.select("id", "stockId", "year", "driveType", "fuelType", "engine", F.array_join("images", ",").alias("images"))


SQL["detail_fields"] = f"""WITH s AS ({SQL["image_sizes"]}), p AS (SELECT p_partkey AS id, p_size, p_partkey % 11 <> 4 AS has FROM part),
  k AS (SELECT id, unnest([0, 1, 4]) AS k FROM p), g AS (SELECT id, string_agg('/i/' || (id + k), ',' ORDER BY k) AS images FROM k LEFT JOIN s ON url = 'https://v.example/i/' || (id + k) WHERE k = 1 OR w IS NULL OR least(w, h) >= 300 GROUP BY id)
  SELECT id, CASE WHEN id % 5 = 0 THEN 'own' || id WHEN has THEN 'K' || id ELSE '' END AS "stockId", CASE WHEN has THEN (1990 + p_size)::VARCHAR ELSE '' END AS year, CASE WHEN has THEN 'AWD' ELSE '' END AS "driveType", CASE WHEN has AND id % 3 > 0 THEN 'Gas' ELSE '' END AS "fuelType",
    CASE WHEN has AND id % 2 = 0 THEN '3.6L V6' ELSE 'old' END AS engine, CASE WHEN has THEN images ELSE '/card.jpg' END AS images FROM p LEFT JOIN g USING (id)"""


def _set_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as runs, every four of their orders as a page: some runs lose their filter, state other counts, lack a page, or
    repeat a vehicle or name one of another host."""
    c, n = _c("o_custkey"), _c("n")
    orders = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).withColumn("m", F.count("*").over(Window.partitionBy("o_custkey")))
    orders = orders.withColumn("page_seq", F.expr("cast(n div 4 + 1 as int)")).withColumn("last", F.expr("cast((m + 3) div 4 as int)"))
    slug = F.when((c % 9 == 4) & (n == 5), F.lit(0)).otherwise(n)  # a vehicle again
    url = F.concat(F.when((c % 9 == 5) & (n == 2), F.lit("http")).otherwise("https"), F.lit("://www.a.example/details/"), _text(c), F.lit("-"), _text(slug))
    items = orders.select(_text(c).alias("run_id"), "page_seq", (n % 4).cast("int").alias("pos"), url.alias("url"))
    p = _c("page_seq")
    status = F.when((c % 9 == 1) & (p == 2), F.lit("")).otherwise(" selected")
    total = F.when((c % 9 == 2) & (p == 2), _c("m") + 1).when(c % 9 == 6, _c("m") + 2).otherwise(_c("m"))
    pager = F.when((c % 9 == 7) & (p == 1), F.lit("no pages")).otherwise(F.concat(F.lit("Page "), _text(F.when((c % 9 == 3) & (p == 3), 1).otherwise(p)), F.lit(" of "), _text("last")))
    html = F.concat(F.lit('<select name="SoldStatus"><option value="All">a</option><option value="AvailableVehicles"'), status, F.lit('>b</option></select><div class="x-pagination"> '), pager, F.lit(' </div><input class="data-inventory-total-records" value="'), _text(total), F.lit('">'))
    pages = orders.where("n % 4 = 0").where(~((c % 9 == 8) & (p == 2))).select(_text(c).alias("run_id"), "page_seq", html.alias("html"))
    return pages, items


@query
def complete_page_sets(spark, sf_dir):
    """How many vehicles each proven run has, and why the others are refused."""
    pages, items = _set_pages(spark, sf_dir)
    good, failed = strict.complete_sets(strict.set_features(pages), items, "www.a.example", "/details/")
    return good.groupBy("run_id").agg(F.count("*").alias("items"), F.lit("").alias("message")).unionByName(failed.select("run_id", F.lit(0).cast("long").alias("items"), "message"))


SQL["complete_page_sets"] = """WITH r AS (SELECT o_custkey AS c, count(*) AS m, (count(*) + 3) // 4 AS y FROM orders GROUP BY 1),
  e AS (SELECT c, m, CASE
    WHEN c % 9 = 1 AND y >= 2 THEN 'site did not retain the Available status filter; refusing to sync unfiltered inventory' WHEN c % 9 = 2 AND y >= 2 THEN 'inventory totals changed during scraping; rerun to get a consistent inventory'
    WHEN c % 9 = 3 AND y >= 3 THEN 'requested page 3 but received page 1; refusing partial sync' WHEN c % 9 = 4 AND m >= 6 THEN 'repeated vehicle https://www.a.example/details/' || c || '-0 on page 2; refusing partial sync'
    WHEN c % 9 = 5 AND m >= 3 THEN 'unexpected detail URL "http://www.a.example/details/' || c || '-2"' WHEN c % 9 = 6 THEN 'collected ' || m || ' vehicles, site reports ' || (m + 2) || '; refusing partial sync'
    WHEN c % 9 = 7 THEN 'missing ''Page X of Y'' pagination; refusing to guess completeness' WHEN c % 9 = 8 AND y >= 2 THEN 'page not landed' ELSE '' END AS message FROM r) SELECT c::VARCHAR AS run_id, CASE WHEN message = '' THEN m ELSE 0 END AS items, message FROM e"""


@query
def capture_choice(spark, sf_dir):
    """Orders as URLs, their lines as captures by five ways: challenged, blocked, without cards, failed and good ones."""
    k, n = _c("l_orderkey"), _c("l_linenumber")
    kind = (k + n * n) % 8
    html = F.when(kind == 0, F.lit("<a href='https://captcha-delivery.com/x'>")).when(kind == 1, F.lit("Please enable JS and disable any ad blocker")).when(kind == 2, F.lit("<title>Just a moment...</title>/cdn-cgi/challenge-platform/")).when(kind != 3, F.lit("<p>page</p>"))
    way = F.element_at(F.array(*map(F.lit, captures.WAYS)), (n % 5 + 1).cast("int"))
    made = table(spark, sf_dir, "lineitem").select(F.lit("r").alias("run_id"), k.alias("url"), way.alias("way"), n.alias("at"), html.alias("html"), F.when(k % 6 == 0, F.lit(None)).otherwise((kind - 4) % 3).cast("int").alias("cards"), F.when(kind == 3, F.lit("HTTP 500")).alias("error"))
    return captures.choose(made).select("url", F.coalesce("way", F.lit("")).alias("way"), F.coalesce("at", F.lit(-1)).alias("at"), F.coalesce("cards", F.lit(-1)).alias("cards"), F.coalesce("message", F.lit("")).alias("message"))


SQL["capture_choice"] = """WITH c AS (SELECT l_orderkey AS url, l_linenumber % 5 AS way, l_linenumber AS spot, (l_orderkey + l_linenumber * l_linenumber) % 8 AS kind, CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE ((l_orderkey + l_linenumber * l_linenumber) % 8 - 4) % 3 END AS cards FROM lineitem),
  d AS (SELECT url, way, arg_max({'spot': spot, 'error': CASE WHEN kind = 3 THEN 'HTTP 500' WHEN kind < 3 THEN 'blocked' END, 'cards': cards, 'challenge': kind = 0}, spot) AS s FROM c GROUP BY url, way),
  w AS (SELECT url, max(s) FILTER (way = 0) AS f, max(s) FILTER (way = 1) AS r, max(s) FILTER (way = 2) AS a, max(s) FILTER (way = 3) AS b, max(s) FILTER (way = 4) AS p FROM d GROUP BY url),
  g AS (SELECT *, f IS NOT NULL AND f.error IS NULL AS fok, a IS NOT NULL AND a.error IS NULL AS aok, b IS NOT NULL AND NOT (a IS NOT NULL AND a.error IS NULL AND coalesce(a.cards >= 2, true)) AS second FROM w),
  h AS (SELECT *, CASE WHEN coalesce(f.challenge, false) THEN NULL WHEN fok AND coalesce(f.cards >= 1, true) THEN 'fetch' WHEN fok AND r IS NOT NULL AND r.error IS NULL AND coalesce(r.cards, 0) > 0 THEN 'rendered' WHEN aok AND NOT second THEN 'first' WHEN second AND b.error IS NULL THEN 'second' WHEN aok THEN NULL WHEN p IS NOT NULL AND p.error IS NULL THEN 'plain' END AS way FROM g),
  i AS (SELECT *, CASE way WHEN 'fetch' THEN f WHEN 'rendered' THEN r WHEN 'first' THEN a WHEN 'second' THEN b WHEN 'plain' THEN p END AS s FROM h)
  SELECT url, coalesce(way, '') AS way, coalesce(s.spot, -1)::INT AS "at", coalesce(s.cards, -1)::INT AS cards, CASE WHEN coalesce(f.challenge, false) THEN 'datadome challenge still present after all bypass strategies' WHEN way IS NULL THEN coalesce(CASE WHEN second THEN b.error END, p.error, a.error, CASE WHEN fok THEN 'HTTP response contained no configured inventory cards' END, 'fetch failed: ' || f.error, 'page not landed') ELSE '' END AS message FROM i"""


def _container_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, their orders as containers with classes by the order's key, some without a link."""
    o, c = _c("o_orderkey"), _c("o_custkey")
    box = F.concat(F.lit('<div class="c'), _text(o % 3), F.lit("  k"), _text(o % 5), F.lit(' 9bad">'), F.when(o % 7 == 0, "x").otherwise('<b><a href="/x">x</a></b>'), F.lit("</div>"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(box)), "").alias("boxes"))
    marked = F.when(c % 4 == 1, F.lit('<i class="vehicle-card"><a href="#">a</a></i><i class="vehicle-card"><a href="#">a</a></i><i class="vehicle-card"></i>')).when(c % 4 == 2, F.lit('<i class="vehicle-card"><a href="#">a</a></i><i class="vehicle-card"></i>')).otherwise("")
    return lists.select(_text(c).alias("url"), F.concat(F.lit("<nav>"), "boxes", F.lit("</nav>"), marked).alias("html"))


@query
def card_selectors(spark, sf_dir):
    """The selector of each page's cards: a well-known one that is dense in links, else the commonest classes."""
    return discover.card_selector(discover.features(_container_pages(spark, sf_dir)))


@query
def card_selector_counts(spark, sf_dir):
    """The two commonest classes of a page's linked containers, of three at least."""
    found = discover.features(_container_pages(spark, sf_dir)).select("url", F.posexplode(discover.common_classes(_c("classes"))).alias("place", "c"))
    return found.select("url", (_c("place") + 1).alias("place"), "c.name", "c.n")


_CLASSES_SQL = """WITH n AS (SELECT o_custkey AS c, unnest(['c' || o_orderkey % 3, 'k' || o_orderkey % 5]) AS name FROM orders WHERE o_orderkey % 7 <> 0), t AS (SELECT c, name, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, name) AS place FROM t QUALIFY place <= 2)"""
SQL["card_selector_counts"] = _CLASSES_SQL + " SELECT c::VARCHAR AS url, place::INT AS place, name, n::INT AS n FROM r"
SQL["card_selectors"] = _CLASSES_SQL + """, s AS (SELECT c, string_agg('.' || name, ', ' ORDER BY place) AS s FROM r GROUP BY c), p AS (SELECT DISTINCT o_custkey AS c FROM orders)
  SELECT c::VARCHAR AS url, CASE WHEN c % 4 = 1 THEN '.vehicle-card' ELSE coalesce(s, '.inventory-item, article, li') END AS selector FROM p LEFT JOIN s USING (c)"""


@query
def block_pages(spark, sf_dir):
    """Texts of documents, some with a block page's words: which of the four rules' pages they are."""
    d = _c("doc_id")
    words = F.when(d % 11 == 0, F.lit(captures.BLOCK_HOST)).when(d % 11 == 1, F.lit(captures.BLOCK_ASK)).when(d % 11 == 2, F.lit(captures.FIREWALL[1])).when(d % 11 == 3, F.concat(F.lit(captures.WAIT_PATH), F.lit(captures.WAIT_TITLE))).when(d % 11 == 4, F.lit(captures.WAIT_TITLE)).otherwise("")
    page = F.concat("text", words)
    return table(spark, sf_dir, "documents").select("doc_id", captures.is_blocked(F.when(d % 22 >= 11, F.repeat(page, 20)).otherwise(page)).alias("blocked"))


SQL["block_pages"] = """WITH p AS (SELECT doc_id, text || CASE doc_id % 11 WHEN 0 THEN 'captcha-delivery.com' WHEN 1 THEN 'Please enable JS and disable any ad blocker' WHEN 2 THEN 'Attention Required! | Cloudflare' WHEN 3 THEN '/cdn-cgi/challenge-platform/Just a moment...' WHEN 4 THEN 'Just a moment...' ELSE '' END AS t FROM documents),
  q AS (SELECT doc_id, t, length(t) * CASE WHEN doc_id % 22 >= 11 THEN 20 ELSE 1 END AS n FROM p) SELECT doc_id, coalesce(contains(t, 'captcha-delivery.com') OR contains(t, 'id="cf-error-details"') OR contains(t, 'Attention Required! | Cloudflare') OR (n < 4000 AND contains(t, 'Please enable JS and disable any ad blocker')) OR (n < 200000 AND contains(t, 'Just a moment...') AND contains(t, '/cdn-cgi/challenge-platform/')), false) AS blocked FROM q"""


def _scheduled(spark: SparkSession, sf_dir: str) -> schedule.Outcome:
    """Customers as source entries of a daily job, with runs and caches of every kind made from their keys."""
    c = _c("c_custkey")
    url = F.concat(F.lit("https://d"), _text(c), F.lit(".example/inventory"))
    customers = table(spark, sf_dir, "customer")
    entries = customers.select(
        F.concat(F.lit("a"), _text(c % 7)).alias("accountID"), F.when(c % 31 == 0, "").otherwise(F.concat(F.lit("d"), _text(c))).alias("dealershipId"), url.alias("url"), F.lit(None).cast("boolean").alias("ftp_sync"), (c % 13 != 5).alias("scrape_sync"),
        F.lit(None).cast("boolean").alias("spreadsheet_sync"), F.when(c % 11 == 3, 10080).otherwise(0).alias("scrapeFrequencyMinutes"), F.lit(None).cast("string").alias("spreadsheetUrl"), F.struct(F.when(c % 17 == 4, " Weekly").otherwise("").alias("type")).alias("schedule"),
    )
    item = lambda stock, vin: F.struct(stock.alias("stockId"), F.lit("").alias("stock"), vin.alias("vin"))
    numbers = F.sequence(F.lit(1), (c % 4).cast("int"))
    items = F.when(c % 4 == 0, F.array().cast("array<struct<stockId:string,stock:string,vin:string>>")).otherwise(F.transform(numbers, lambda i: item(F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("S"), i.cast("string"))), F.when(i == 2, F.lit("V")).otherwise("v "))))
    error = F.struct(F.lit("SCRAPE_RENDER_FAILED").alias("code"), F.when(c % 8 == 0, "all strategies failed").otherwise("HTTP 500").alias("message"))
    runs = customers.where("c_custkey % 19 <> 6").select(url.alias("url"), F.lit(1).alias("at"), F.when(c % 23 == 7, "no template").alias("config_error"), items.alias("items"), F.when(c % 5 < 2, F.array(error)).otherwise(F.array().cast("array<struct<code:string,message:string>>")).alias("errors"))
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    cache = customers.where("c_custkey % 3 = 1").select(F.concat(F.lit("https://www.d"), _text(c), F.lit(".example/used")).alias("source_url"), at.alias("updated_at"), F.when(c % 10 == 1, F.slice(items, 1, 0)).otherwise(F.array(item(F.lit("C"), F.lit("")))).alias("items"))
    flagged = customers.where("c_custkey % 9 = 2").select(F.concat(url, F.lit("/")).alias("source_url"))
    return schedule.outcomes(entries, runs, cache, flagged, flagged.limit(0), "daily-upsert", "daily")


@query
def scheduled_activity(spark, sf_dir):
    """What each due entry's run and import report."""
    return _scheduled(spark, sf_dir).activity.select("dealershipId", "accountID", "phase", "status", "sourceUrl", "itemCount", "message")


@query
def scheduled_imports(spark, sf_dir):
    """Rows that the job imports."""
    return _scheduled(spark, sf_dir).inventory.select("accountID", "dealershipId", "sourceUrl", "pos", "stockId")


_SCHEDULED_SQL = """WITH e AS (SELECT c_custkey AS c, 'a' || c_custkey % 7 AS a, 'd' || c_custkey AS d, 'https://d' || c_custkey || '.example/inventory' AS u FROM customer WHERE c_custkey % 31 <> 0 AND c_custkey % 13 <> 5 AND c_custkey % 11 <> 3 AND c_custkey % 17 <> 4),
  r AS (SELECT *, c % 19 <> 6 AS has_run, c % 3 = 1 AS has_cache, CASE WHEN c % 10 = 1 THEN 0 ELSE 1 END AS in_cache, c % 4 AS n, c % 5 < 2 AS err, CASE WHEN c % 8 = 0 THEN 'all strategies failed' ELSE 'HTTP 500' END AS err_message FROM e),
  w AS (SELECT *, CASE WHEN c % 9 = 2 THEN CASE WHEN has_cache THEN 'cache' ELSE 'no_cache' END WHEN NOT has_run THEN 'no_run' WHEN c % 23 = 7 THEN 'no_config' WHEN n = 0 AND err AND c % 8 = 0 THEN CASE WHEN has_cache THEN 'fallback' ELSE 'blocked' END ELSE 'run' END AS way FROM r),
  m AS (SELECT *, CASE WHEN way IN ('cache', 'fallback') THEN in_cache WHEN way = 'run' THEN CASE WHEN n >= 1 THEN 1 ELSE 0 END ELSE 0 END AS items, CASE WHEN err THEN err_message WHEN n = 0 THEN 'No inventory items returned' ELSE '' END AS said FROM w),
  s AS (SELECT *, CASE WHEN way IN ('cache', 'fallback') THEN in_cache WHEN way = 'run' AND c % 3 > 0 THEN n ELSE 0 END AS stocked FROM m)"""
SQL["scheduled_activity"] = _SCHEDULED_SQL + """ SELECT d AS "dealershipId", a AS "accountID", 'scrape' AS phase, CASE WHEN items = 0 THEN 'failed' WHEN way <> 'run' THEN 'cached' WHEN err THEN 'partial_success' ELSE 'success' END AS status, u AS "sourceUrl", items::BIGINT AS "itemCount",
    CASE WHEN way = 'no_cache' THEN 'Cache-only source has no cached inventory' WHEN way = 'no_run' THEN 'Scrape did not complete' WHEN way = 'no_config' THEN 'Site configuration failed: no template' WHEN way IN ('cache', 'fallback') AND in_cache = 0 THEN 'Cached inventory is empty'
      WHEN way = 'cache' THEN 'Used cached inventory from 2024-01-02T03:04:05Z' WHEN way = 'fallback' THEN 'Live scrape failed; used cached inventory from 2024-01-02T03:04:05Z: ' || said ELSE said END AS message FROM s
  UNION ALL SELECT d, a, 'import', CASE WHEN stocked > 0 THEN 'success' ELSE 'skipped' END, u, stocked, CASE WHEN stocked > 0 THEN '' ELSE 'No rows with stock IDs to import' END FROM s WHERE way IN ('cache', 'fallback', 'run')"""
SQL["scheduled_imports"] = _SCHEDULED_SQL + """ SELECT a AS "accountID", d AS "dealershipId", u AS "sourceUrl", (k - 1)::INT AS pos, CASE WHEN way = 'run' THEN 'S' || k ELSE 'C' END AS "stockId" FROM (SELECT *, unnest(range(1, stocked + 1)) AS k FROM s)"""


@query
def diagnostic_log(spark, sf_dir):
    """Runs of events as the outputs of fetchers, some lines noise or of other types: the events that a bounded log keeps."""
    e = _c("event_id")
    line = F.when(e % 5 == 0, F.lit("noise")).when(e % 7 == 0, F.lit(events.PREFIX + '{"count": "x"}')).when(e % 11 == 0, F.lit(events.PREFIX + "{")).otherwise(F.concat(F.lit(events.PREFIX + '{"stage": "'), "event_type", F.lit('", "count": '), _text(e), F.lit(', "message": "token=abc"}')))
    outputs = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 400").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("output"))
    return events.output_events(outputs.select(_text("k").alias("log"), "output")).select("log", "place", "dropped", "stage", "count", "message")


SQL["diagnostic_log"] = """WITH l AS (SELECT event_id // 400 AS k, event_id, event_type FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS up, count(*) OVER (PARTITION BY k) AS n FROM l)
  SELECT k::VARCHAR AS log, (CASE WHEN up <= 16 THEN up ELSE up - greatest(n - 160, 0) END)::BIGINT AS place, greatest(n - 160, 0) AS dropped, event_type AS stage, event_id AS count, 'token=[redacted]' AS message FROM r WHERE up <= 16 OR up > n - 144"""


@query
def url_refinements(spark, sf_dir):
    """Parts as listing URLs with parameters of every kind: the sort and types that they ask for, or what is wrong."""
    p = _c("p_partkey")
    given = F.concat(
        F.when(p % 3 == 0, F.concat(F.lit("_dFR%5Btype%5D%5B1%5D="), F.element_at(F.array(*map(F.lit, ("Used", "New", "Old"))), (p % 9 / 3 + 1).cast("int")), F.lit("&"))).otherwise(""), F.when(p % 5 == 0, "_dFR[type][0]=New&").otherwise(""), F.when(p % 7 == 0, "idx=year_high_to_low&").when(p % 7 == 1, "idx=other&").otherwise(""),
        F.when(p % 11 == 0, "page=2&").otherwise(""), F.when(p % 13 == 0, "idx=a&idx=b&").otherwise(""), F.when(p % 17 == 0, "a;b&").otherwise(""), F.lit("utm_source=x&utm_source=y&gclid=1"),
    )
    url = F.concat(F.when(p % 19 == 0, "https://b.example/used").otherwise("https://A.example/used/"), F.lit("?"), given)
    sources = table(spark, sf_dir, "part").select(p.alias("id"), url.alias("url"), F.lit("https://a.example/used").alias("base_url"), F.when(p % 23 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Used"), F.lit("New"))).alias("vehicle_types"), F.lit("").alias("vehicle_type"))
    return refine.refinements(sources).select("id", F.coalesce("sort", F.lit("")).alias("sort"), F.coalesce(F.array_join("types", ","), F.lit("")).alias("types"), F.coalesce("error", F.lit("")).alias("error"))


SQL["url_refinements"] = """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 9 WHEN 0 THEN 'Used' WHEN 3 THEN 'New' ELSE 'Old' END END AS t1, CASE WHEN p_partkey % 5 = 0 THEN 'New' END AS t0, CASE WHEN p_partkey % 7 = 0 THEN 'year_high_to_low' WHEN p_partkey % 7 = 1 THEN 'other' END AS idx FROM part),
  e AS (SELECT *, CASE WHEN id % 23 = 0 THEN 'Cars Commerce vehicle types are required' WHEN id % 19 = 0 THEN 'Cars Commerce template does not match source host/path' WHEN id % 17 = 0 THEN 'invalid semicolon separator in query'
    WHEN t1 = 'Old' THEN 'inventory type does not match configured ["Used" "New"] page' WHEN id % 13 = 0 THEN 'unsupported repeated inventory parameter "idx"' WHEN idx = 'other' THEN 'unsupported inventory sort "other"' WHEN id % 11 = 0 THEN 'unsupported inventory query parameter "page"' ELSE '' END AS error FROM p)
  SELECT id, CASE WHEN error <> '' THEN '' WHEN idx IS NULL THEN 'low_price' ELSE 'year' END AS sort, CASE WHEN error <> '' THEN '' WHEN t0 IS NULL AND t1 IS NULL THEN 'Used,New' WHEN t0 = t1 OR t1 IS NULL THEN t0 ELSE concat_ws(',', t0, t1) END AS types, error FROM e"""


@query
def extract_rows(spark, sf_dir):
    """All extractors over pages of four kinds: embedded JSON with keys in several spellings, repeated and other objects; loop
    markup; cards; and plain text, where the template's patterns count."""
    p, k = _c("p_partkey"), _c("k")
    given = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else _text(x) for x in parts])
    stock = F.when(p % 2 == 0, given('"Stock_No": "S', p, '"')).otherwise(given('"stock-number": "S', p, '"'))
    car = F.concat(F.lit('{"Make": "'), "p_brand", F.lit('", "MODEL": " '), "p_type", F.lit('", "model year": 0, "year": '), _text(1990 + _c("p_size")), F.lit(", "), stock, given(', "vdp_url": "/v/', p, '", "price": ', p, '.4, "odometer": "', p, ' mi", "photos": [{"src": "/i/', p, '.jpg"}, "no", "/j.jpg"], "vin": null}'))
    json = F.concat(F.when(p % 7 == 0, '{"make": "x", "model": "y"}, ').otherwise(""), car, F.when(p % 5 == 0, F.concat(F.lit(", "), car)).otherwise(""))
    loop = given('<div data-elementor-type="loop-item" class="x vehicle type-vehicle make-land-rover model-m', p, ' stock-s-9"><h3><a href="https://a.example/vehicle-details/', p, '">Title ', p, '</a></h3><img src="data:image/x" data-src="/i/', p, '.jpg"> Now $ 1,', p, " with 12,345 miles ", F.when(p % 2 == 0, given("STOCK# K", p)).otherwise(""), "</div>")
    card = given('<article class="card"><h2 class="t">Card ', p, '</h2><a href="#">x</a><a href="/inventory/', p, '">y</a><a href="/finance">z</a><span class="p">', F.when(p % 2 == 0, given("$", p)).otherwise("call"), '</span><meta itemprop="sku" content="S', p, '"><b data-vin="', _number(), '"></b> or $77 <img data-src="/i/', p, '.jpg"></article>')
    part = F.when(k % 4 == 0, json).when(k % 4 == 1, loop).when(k % 4 == 2, card).otherwise(given("STK", p, ";"))
    lists = table(spark, sf_dir, "part").withColumn("k", F.expr(f"p_partkey div {PAGE_PARTS}")).withColumn("v", part).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "v"))), lambda x: x["v"]), "\n").alias("body"))
    html = F.when(k % 4 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": [{"list": ['), F.replace("body", F.lit("}\n{"), F.lit("},\n{")), F.lit("]}]}</script>"))).otherwise(_c("body"))
    pages = lists.select(F.lit("r").alias("run_id"), k.cast("int").alias("page_seq"), F.lit("https://a.example/list").alias("url"), html.alias("html"))
    site = {"cardSelector": "article.card", "titleSelector": ".t", "urlSelector": "a[href]", "priceSelector": ".p", "imageSelector": "img", "stockPatterns": ["STK([0-9]+)"]}
    return extract.extract(pages, site).select("page_seq", "extractor", "pos", "title", "url", "stockId", "vin", "year", "make", "model", "price", "mileage", "primaryImage", F.size("images").alias("images"))


SQL["extract_rows"] = f"""WITH p AS (SELECT *, {PAGE_OF_PART} AS k, {PLACE_SQL} AS n, '/i/' || p_partkey || '.jpg' AS i FROM part)
  SELECT k::INT AS page_seq, 3::INT AS extractor, n AS pos, (1990 + p_size) || ' ' || p_brand || '  ' || p_type AS title, '/v/' || p_partkey AS url, 'S' || p_partkey AS "stockId", '' AS vin, (1990 + p_size)::VARCHAR AS year, p_brand AS make, ' ' || p_type AS model, p_partkey::VARCHAR AS price, p_partkey || ' mi' AS mileage, i AS "primaryImage", 2::INT AS images FROM p WHERE k % 4 = 0
  UNION ALL SELECT k, 1, n + 1, 'Title ' || p_partkey, 'https://a.example/vehicle-details/' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'K' || p_partkey ELSE 'S9' END, '', '', 'land rover', 'm' || p_partkey, '$1,' || p_partkey, '12,345 mi', i, 1 FROM p WHERE k % 4 = 1
  UNION ALL SELECT k, 2, n, 'Card ' || p_partkey, '/inventory/' || p_partkey, 'S' || p_partkey, {NUMBER_SQL}, '', '', '', CASE WHEN p_partkey % 2 = 0 THEN '$' || p_partkey ELSE '$77' END, '', i, 1 FROM p WHERE k % 4 = 2
  UNION ALL SELECT k, 4, n, '', '', p_partkey::VARCHAR, '', '', '', '', '', '', '', 0 FROM p WHERE k % 4 = 3"""


@query
def strict_listings(spark, sf_dir):
    """Listings of runs whose pages agree: others state another total, repeat a number, lack a stock number or a page."""
    p, k, run = _c("p_partkey"), _c("k"), F.expr("k div 4")
    styles, mechanical, own_run = F.struct(F.lit("Red").alias("exterior_color")), F.struct(F.lit("V6").alias("engine"), (p % 50).alias("city_mpg")), F.expr(f"p_partkey div {4 * PAGE_PARTS}")
    again = F.concat(F.lit("1HGCM82633A"), F.lpad(_text((p - 1) % 1_000_000), 6, "0"))
    car = F.struct(
        F.when((own_run % 5 == 2) & (p % 100 == 7), again).otherwise(_number()).alias("vin"), F.when((own_run % 5 == 3) & (p % 100 == 9), F.lit(None)).otherwise(F.concat(F.lit("s"), _text(p))).alias("stock"),
        (1990 + _c("p_size")).alias("year"), _c("p_brand").alias("make"), _c("p_type").alias("model"), F.lit("LX").alias("trim"), F.concat(F.lit("/v/"), _text(p)).alias("vdp_url"), (p * 10).alias("mileage"), styles.alias("styles"), mechanical.alias("mechanical"), F.struct(_text(F.floor("p_retailprice")).alias("our_price")).alias("pricing"), F.struct(F.array(F.concat(F.lit("/i/"), _text(p)), F.lit("/j")).alias("images")).alias("media"),
    )
    lists = _lists(spark, sf_dir, car, F.expr(f"p_partkey div {PAGE_PARTS}"))
    sizes = lists.select(run.alias("run"), F.size("list").alias("n")).groupBy("run").agg(F.sum("n").alias("all"), F.count("*").alias("pages"))
    body = F.struct((k % 4 + 1).alias("page"), _c("pages").alias("total_pages"), F.when((run % 5 == 1) & (k % 4 == 1), _c("all") + 1).otherwise(_c("all")).alias("total"), _c("list").alias("listings"))
    payloads = lists.withColumn("run", run).join(sizes, "run").where((_c("run") % 5 != 4) | (k % 4 != 0)).select(_text("run").alias("run_id"), k.cast("int").alias("page_seq"), F.to_json(body).alias("payload"))
    good, _ = strict.all_or_nothing(strict.listings(payloads))
    return good.select("run_id", "page_seq", "pos", "title", "vin", "stockId", "url", "year", "make", "model", "price", "mileage", "color", "engine", "cityMPG", "primaryImage", F.size("images").alias("images"))


SQL["strict_listings"] = f"""WITH p AS (SELECT *, {PAGE_OF_PART} AS k, {PAGE_OF_PART} // 4 AS run, {PLACE_SQL} AS pos FROM part), r AS (SELECT run, count(DISTINCT k) AS pages, bool_or(p_partkey % 100 = 7) AS seven, bool_or(p_partkey % 100 = 9) AS nine, bool_or(k % 4 = 1) AS second, bool_or(k % 4 = 0) AS first FROM p GROUP BY run)
  SELECT run::VARCHAR AS run_id, k::INT AS page_seq, pos, (1990 + p_size) || ' ' || p_brand || ' ' || p_type || ' LX' AS title, {NUMBER_SQL} AS vin, 's' || p_partkey AS "stockId", '/v/' || p_partkey AS url, (1990 + p_size)::VARCHAR AS year, p_brand AS make, p_type AS model, floor(p_retailprice)::BIGINT::VARCHAR AS price,
    (p_partkey * 10)::VARCHAR AS mileage, 'Red' AS color, 'V6' AS engine, (p_partkey % 50)::VARCHAR AS "cityMPG", '/i/' || p_partkey AS "primaryImage", 2::INT AS images
  FROM p JOIN r USING (run) WHERE NOT (run % 5 = 1 AND second) AND NOT (run % 5 = 3 AND nine) AND NOT (run % 5 = 4 AND first) AND NOT (run % 5 = 2 AND seven)"""


@query
def joined_posts(spark, sf_dir):
    """Listings with the stock numbers and galleries of their posts; a run with one that does not fit is left out."""
    p = _c("p_partkey")
    parts = table(spark, sf_dir, "part")
    listed = parts.select(F.expr("p_partkey div 10").alias("run_id"), p.alias("id"), F.lower(_number()).alias("vin"))
    posts = parts.where("p_partkey % 97 <> 5").select(p.alias("id"), F.when(p % 83 == 3, "other").otherwise(_number()).alias("vin"), F.when(p % 89 == 4, F.lower(_number())).otherwise(F.concat(F.lit("S"), _text(p))).alias("stock"))
    media = parts.where("p_partkey % 3 > 0").select(p.alias("parent"), F.explode(F.sequence(F.lit(1), (p % 3).cast("int"))).alias("rank")).select("parent", (-_c("rank")).alias("rank"), F.concat(F.lit("/i/"), _text("rank")).alias("url"))
    good, _ = strict.joined_posts(listed, posts, media)
    return good.select("run_id", "id", "vin", "stock", F.array_join("images", ",").alias("images"))


SQL["joined_posts"] = f"""WITH p AS (SELECT p_partkey AS id, p_partkey // 10 AS run_id, lower({NUMBER_SQL}) AS vin, p_partkey % 97 = 5 OR p_partkey % 83 = 3 OR p_partkey % 89 = 4 AS bad FROM part)
  SELECT run_id, id, vin, 'S' || id AS stock, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '/i/1' ELSE '/i/2,/i/1' END AS images FROM p WHERE run_id NOT IN (SELECT run_id FROM p WHERE bad)"""


@query
def sync_responses(spark, sf_dir):
    """Customers as syncs of inventory, some without owner, refused, or for the cache alone."""
    c = _c("c_custkey")
    customers = table(spark, sf_dir, "customer")
    host = lambda n: F.concat(F.lit("https://s"), _text(n), F.lit(".example/list"))
    item = lambda i: F.struct(F.when(i % 2 == 1, F.concat(F.lit("S"), i.cast("string"))).otherwise("").alias("stockId"), F.lit("").alias("stock"))
    items = F.when(c % 3 == 0, F.array().cast("array<struct<stockId:string,stock:string>>")).otherwise(F.transform(F.sequence(F.lit(1), (c % 3).cast("int")), item))
    url = F.when(c % 7 == 0, "no url").otherwise(F.concat(host(c % 40), F.when(c % 3 == 0, "/").otherwise("")))
    requests = customers.select(c.alias("id"), url.alias("url"), c.alias("at"), F.when(c % 5 == 0, "").otherwise(F.concat(F.lit("d"), _text(c))).alias("dealershipId"), F.when(c % 4 > 0, F.concat(F.lit("a"), _text(c))).alias("accountID"), (c % 6 == 1).alias("skipUpsert"), items.alias("items"))
    entries = customers.where("c_custkey < 40 and c_custkey % 3 < 2").select(c.alias("seq"), F.upper(F.concat(F.lit("https://s"), _text(c), F.lit(".example"))).alias("h"), F.concat(F.lit("D"), _text(c)).alias("dealershipId"), F.concat(F.lit("A"), _text(c)).alias("accountID"))
    return ingest.sync_requests(requests, entries.withColumn("url", F.concat("h", F.lit("/list")))).responses


SQL["sync_responses"] = """WITH r AS (SELECT c_custkey AS c, c_custkey % 7 > 0 AS valid, c_custkey % 6 = 1 AS skip, c_custkey % 40 AS k, (c_custkey % 3 > 0)::INT AS n FROM customer), o AS (SELECT *, valid AND k % 3 < 2 AND k IN (SELECT c_custkey FROM customer) AS known FROM r),
  w AS (SELECT *, CASE WHEN skip THEN '' WHEN c % 5 > 0 THEN 'd' || c WHEN known THEN 'D' || k ELSE '' END AS d, CASE WHEN skip THEN '' WHEN c % 4 > 0 THEN 'a' || c WHEN known THEN 'A' || k ELSE '' END AS a FROM o)
  SELECT c AS id, CASE WHEN valid THEN 'https://s' || k || '.example/list' || CASE WHEN c % 3 = 0 THEN '/' ELSE '' END ELSE 'no url' END AS url, CASE WHEN valid THEN '' ELSE 'INVALID_REQUEST' END AS code, CASE WHEN valid THEN '' ELSE 'valid url is required' END AS message, d AS "dealershipId", a AS "accountID",
    CASE WHEN valid THEN n ELSE 0 END AS "cachedItems", valid AND NOT skip AND d <> '' AND a <> '' AND n > 0 AS upserted FROM w"""
