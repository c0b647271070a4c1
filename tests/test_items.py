"""Items, URLs, duplicates, extraction and platforms: given rows and the rows they must become."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions import html as tree
from gleanery.functions import identity, text, urls
from gleanery.operators import dedupe, details, diagnostics, extract, inventory, normalize, paginate, platforms, stores
from gleanery.plans import pipeline

SITE = {"cardSelector": ".vehicle-card", "titleSelector": "h2", "urlSelector": "a[href]", "imageSelector": "img", "stockSelector": ".stock", "priceSelector": ".price", "mileageSelector": ".miles", "stockPatterns": [r"STK:(\w+)"]}


def one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def items(spark, *rows):
    full = [{n: "" for n in schemas.ITEM_TEXTS} | {n: [] for n in schemas.ITEM_ARRAYS} | r | {"seq": i, "run": "r", "source_url": "https://dealer.test", "dealer_id": "d"} for i, r in enumerate(rows)]
    schema = ", ".join([*(f"{n} string" for n in schemas.ITEM_TEXTS), *(f"{n} array<string>" for n in schemas.ITEM_ARRAYS), "seq long, run string, source_url string, dealer_id string"])
    names = [*schemas.ITEM_TEXTS, *schemas.ITEM_ARRAYS, "seq", "run", "source_url", "dealer_id"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema)


def rows(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (identity.stock_number, [" Stock # 26027 ", "# K14394A", "#K14394A", "Stock # K14394A", "K14394A", "Stock #", "Stock Number:", "#", ""], ["26027", "K14394A", "K14394A", "K14394A", "K14394A", "", "", "", ""]),
        (text.mileage, ["Mileage: 93,821", " Miles - 93,821 ", "Odometer 93,821", "93,821"], ["93,821"] * 4),
        (text.strip_label, ["Turbo Gasoline I-4", "Engine: V6", "WhiteMiles: 43K", "Color: Gray", "Exterior Color : Red"], ["Turbo Gasoline I-4", "V6", "White", "Gray", "Red"]),
        (identity.valid_vin, [" 1hgcm82633a004352", "1HGCM82633A00435", "IHGCM82633A004352", "ABCDEFGHJKLMNPRST"], ["1HGCM82633A004352", "", "", ""]),
        (identity.structured_vin, ["1Z87L8S906031", "short", "ABCDEFGHJKL"], ["1Z87L8S906031", "", ""]),
        (identity.plausible_stock, ["2021", "CERTIFIED", "P558569", " "], ["", "", "P558569", ""]),
        (identity.listing_id, ["https://a.test/x/2022/2191308/", "/inventory/example-truck/", "https://a.test/7?x"], ["2191308", "", "7"]),
        (text.miles_per_litre, ["25", "0", "n/a"], ["6.60 mi/L", "", ""]),
        (text.mpg_value, ["about 25.50 combined", "none"], ["25.5 MPG", "none"]),
        (text.infer_style, ["Used Sedan SUV", "minivan", "Crossover", "x"], ["sedan", "van", "suv", ""]),
        (text.slug, [" Grand  Cherokee! ", "A-B"], ["grand-cherokee", "a-b"]),
        (urls.canonical_key, ["HTTPS://A.test/X/?q#f", "https://a.test/", " "], ["https://a.test/x", "https://a.test/", ""]),
        (urls.cache_key, ["HTTPS://A.test/X/?q#f"], ["https://a.test/X?q"]),
        (urls.source_key, ["https://A.test/"], ["https://a.test"]),
        (urls.template_key, ["https://A.test:8080/New/Inventory/", "https://a.test"], ["url::a.test/new/inventory", "url::a.test/_root"]),
        (urls.host_key, ["https://www.a.test/x", "https://WWW.a.test"], ["a.test", "www.a.test"]),
        (urls.diagnostic_url, ["https://u:p@a.test/x?q=1#f", "x", ""], ["https://a.test/x", "[invalid URL]", ""]),
        (urls.is_unsafe, ["http://localhost/x", "http://127.0.0.1", "http://10.1.2.3", "http://172.20.0.1", "https://a.test", "http://[::1]/", "x"], [True, True, True, True, False, True, True]),
        (text.redact, ["see https://u:p@a.test/x?k=1 now", "token = abc\nnext", "Bearer abc.def"], ["see https://a.test/x now", "token = [redacted]\nnext", "Bearer [redacted]"]),
        (lambda c: inventory.listing_score(c), ["/inventory/a", "https://google.com/maps/x", "#", "https://a.test/viewdetails/1?compare", "tel:1"], [12, -100, -100, 7, -100]),
        (paginate.total, ["1 - 20 of 1,148 vehicles", "Total 7", "12 cars available", "none"], [1148, 7, 12, 0]),
        (platforms.grouped, ["1234567.5", "0", "-3"], ["1,234,568", "", ""]),
        (platforms.panel_price, ["<b>$48,967</b> PROMISE PRICE", "MSRP price $9 sale price: $7", "suggested price $5", ""], ["$48,967", "$7", "$5", ""]),
    ],
)
def test_expressions(spark, make, given, want):
    if make is platforms.grouped:
        assert one(spark, lambda c: make(c.cast("double")), *given) == want
    else:
        assert one(spark, make, *given) == want


def test_resolution_is_rfc3986(spark):
    from urllib.parse import urljoin

    base = "https://a.test/b/c/d;p?q"
    refs = ["g", "./g", "g/", "/g", "?y", "g?y", "#s", "../g", "../..", "../../g", "../../../g", "//h.test/x", "./", ".", "g/../h", "https://z.test/k"]
    assert one(spark, lambda c: urls.resolve(F.lit(base), c), *refs) == [urljoin(base, r) for r in refs]


def test_normalize(spark):
    got = rows(normalize.normalize(items(spark, {"title": " 2021   Toyota   Camry ", "url": "/inventory/a", "images": ["/img/vehicle.jpg", "/logo.png"]}, {"title": "Used 2022 Tesla Model Y Long", "stockId": "N/A", "vin": "1hgcm82633a004352"}, {"stockId": "", "url": "/x/2022/2191308/"})), "seq")
    assert (got[0]["year"], got[0]["make"], got[0]["model"], got[0]["url"], got[0]["primaryImage"]) == ("2021", "Toyota", "Camry", "https://dealer.test/inventory/a", "https://dealer.test/img/vehicle.jpg")
    assert (got[1]["make"], got[1]["model"], got[1]["stockId"]) == ("Tesla", "Model Y", "1HGCM82633A004352") and got[2]["stockId"] == "2191308"


def test_dedupe_cases(spark):
    same = lambda *r: rows(dedupe.dedupe(items(spark, *r), ["run"]), "seq")
    assert len(same({"stockId": "A", "url": "u1"}, {"stockId": "A", "primaryImage": "i.jpg"})) == 1
    assert same({"title": "$666,399", "stockId": "A"}, {"title": "2020 Kia", "stockId": "A"})[0]["title"] == "2020 Kia"
    assert same({"model": "Model", "stockId": "A"}, {"model": "Model S", "stockId": "A"})[0]["model"] == "Model S"
    assert same({"model": "Civic", "stockId": "A"}, {"model": "Civics", "stockId": "A"})[0]["model"] == "Civic"
    weak = same({"url": "https://a.test/1/"}, {"url": "https://a.test/1", "stockId": "S", "vin": "V"})
    assert len(weak) == 1 and weak[0]["vin"] == "V"
    assert len(same({"url": "https://a.test/1"}, {"url": "https://a.test/2"})) == 2 and len(same({"title": "only"})) == 1 and not same({})
    assert len(same({"stockId": "A", "vin": "V1"}, {"stockId": "A", "vin": "V2"}, {"stockId": "A", "vin": "v2"})) == 2


def sequential(given):
    """Duplicates resolved one row after the other."""
    key_url = lambda u: re.sub("/$", "", re.sub(r"[?#].*$", "", u)).lower()

    def key(i):
        for p, v in (("stock:", (i["stockId"] or i["stock"]).upper()), ("vin:", i["vin"].upper()), ("url:", key_url(i["url"])), ("img:", i["primaryImage"] or (i["images"][0] if i["images"] else "")), ("content:", (i["title"] + "|" + i["price"]).lower().strip("|"))):
            if v:
                return p + v
        return ""

    def merge(a, b):
        out = dict(a)
        for n in ("url", "vin", "price"):
            out[n] = a[n] or b[n]
        out["images"] = list(dict.fromkeys(a["images"] + b["images"]))
        if not a["title"] or re.fullmatch(r"\$?\d+", a["title"]) and not re.fullmatch(r"\$?\d+", b["title"]):
            out["title"] = b["title"]
        longer = b["model"][: len(a["model"])].lower() == a["model"].lower() and b["model"][len(a["model"]) :].startswith(" ")
        out["model"] = b["model"] if not a["model"] or longer else a["model"]
        out["primaryImage"] = a["primaryImage"] or b["primaryImage"] or next(iter(out["images"]), "")
        return out

    seen, out = {}, []
    for i in given:
        k = key(i)
        if not k:
            continue
        if k in seen and out[seen[k]]["vin"] and i["vin"] and out[seen[k]]["vin"].upper() != i["vin"].upper():
            k = "vin:" + i["vin"].upper()
        if k in seen:
            out[seen[k]] = merge(out[seen[k]], i)
        else:
            seen[k] = len(out)
            out.append(i)
    strong = {}
    named = [bool(i["stockId"] or i["stock"] or i["vin"]) for i in out]
    for n, i in enumerate(out):
        if named[n] and i["url"]:
            strong.setdefault(key_url(i["url"]), n)
    gone = set()
    for n, i in enumerate(out):
        if not named[n] and i["url"] and key_url(i["url"]) in strong:
            out[strong[key_url(i["url"])]] = merge(out[strong[key_url(i["url"])]], i)
            gone.add(n)
    return [i for n, i in enumerate(out) if n not in gone]


def test_dedupe_is_the_sequential_rule(spark):
    rnd = random.Random(5)
    pick = lambda *v: rnd.choice(v)
    runs = []
    for run in range(60):
        for _ in range(rnd.randint(1, 9)):
            runs.append((run, {"stockId": pick("", "", "A", "b"), "vin": pick("", "", "V1", "v2"), "url": pick("", "https://a.test/1", "https://a.test/2/?x"), "title": pick("", "$5", "Car", "Bus"), "price": pick("", "$1"), "images": pick([], [], ["a.jpg"], ["b.jpg", "a.jpg"]), "model": pick("", "Model", "model s", "Model S Plaid", "Models"), "primaryImage": pick("", "", "p.jpg")}))
    df = items(spark, *[r for _, r in runs]).withColumn("run", F.element_at(F.array(*[F.lit(str(n)) for n, _ in runs]), (F.col("seq") + 1).cast("int")))
    fields = ("stockId", "vin", "url", "title", "price", "images", "model", "primaryImage")
    got = rows(dedupe.dedupe(df, ["run"]), "seq")
    for run in range(60):
        want = sequential([{"stock": ""} | r for n, r in runs if n == run])
        assert [[g[f] for f in fields] for g in got if g["run"] == str(run)] == [[w[f] for f in fields] for w in want]


def test_counts(spark):
    df = items(spark, {"vin": "a"}, {"vin": "A "}, {"vin": "b"}, {"stockId": "s"}, {"title": "t"})
    got = inventory.inventory_counts(df, ["run"]).first()
    assert (got.unique_vins, got.unique_stocks, got.identities, got.inventory) == (2, 1, 3, 3)
    assert inventory.inventory_counts(items(spark, {"title": "t"}, {"title": "u"}), ["run"]).first().inventory == 2


def test_html_tree():
    doc = tree.parse("<ul><li class='a b'><a href='/x'>One<b>two</b></a><li id=z data-vin='1'>T<p>q<p>r</ul><script>var t='</p>'</script>")
    assert [n.text() for n in doc.find("li")] == ["Onetwo", "Tqr"] and doc.first_text("li > a") == "Onetwo" and not doc.find("")
    assert [n.tag for n in doc.find(".a.b a[href*='x'], #z p")] == ["a", "p", "p"] and len(doc.find("li:contains('T')")) == 1 and not doc.find("ul > a")


LIST = """<div class="vehicle-card"><a href="/inventory/car-1"><h2>2021 Toyota Camry</h2></a><span class="stock">Stock # A1</span><span class="price">$11,998</span><img src="/img/vehicle-1.jpg"></div>
<div class="vehicle-card"><a href="/finance">f</a><a href="/inventory/car-2"><h2>2020 Honda Civic</h2></a><span data-vin="1HGCM82633A004352"></span><b>$9,000</b><img src="data:image/gif;x" data-src="/img/vehicle-2.jpg"></div>"""
NEXT = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"cars": [{"make": "Kia", "model": "Rio", "year": 2019, "stockNumber": "A05504", "exteriorColor": "Red", "allPhotos": "/a.jpg,/b.jpg", "price": 5.0}, {"name": "no car"}]}}) + "</script>"
LOOP = '<div data-elementor-type="loop-item" class="x vehicle type-vehicle stock-b-7 make-land-rover model-evoque"><h3><a href="https://dealer.test/vehicle-details/7">2018 Land Rover</a></h3><img data-src="/img/7.jpg">$ 7,500 <i>12,000 miles</i></div>'


def pages(spark, *htmls):
    return spark.createDataFrame([("r", i, f"https://dealer.test/list?page={i + 1}", h) for i, h in enumerate(htmls)], "run_id string, page_seq int, url string, html string")


def test_extractors(spark):
    got = rows(extract.extract(pages(spark, LIST + NEXT + LOOP, "STK:Z9 STK:Z8", None), SITE), "page_seq", "extractor", "pos")
    assert [(g["extractor"], g["stockId"].strip()) for g in got] == [(1, "B7"), (2, "Stock # A1"), (2, ""), (3, "A05504"), (4, "Z9"), (4, "Z8")]
    assert got[0]["make"] == "land rover" and got[0]["mileage"] == "12,000 mi" and got[0]["price"] == "$7,500"
    assert got[2]["url"] == "/inventory/car-2" and got[2]["vin"] == "1HGCM82633A004352" and got[2]["price"] == "$9,000" and got[2]["primaryImage"] == "/img/vehicle-2.jpg"
    assert got[3]["images"] == ["/a.jpg", "/b.jpg"] and got[3]["title"] == "2019 Kia Rio" and got[3]["color"] == "Red" and got[3]["price"] == "5"


def test_pipeline(spark):
    detail = spark.createDataFrame([("https://dealer.test/inventory/car-1", "<dl><dt>VIN:</dt><dd>1HGCM82633A004353</dd><dt>Engine</dt><dd>V6</dd></dl><ul><li>Drivetrain: AWD</li></ul>")], "url string, html string")
    out = pipeline.run(pages(spark, LIST, LIST + NEXT), SITE, detail, dealer_id="d1")
    got = rows(out.items, "seq")
    assert [g["stockId"] for g in got] == ["A1", "1HGCM82633A004352", "A05504"]
    assert got[0]["vin"] == "1HGCM82633A004353" and got[0]["engine"] == "V6" and got[0]["driveType"] == "AWD" and got[0]["dealerId"] == "d1"
    assert [(r.items, r.errors, r.status) for r in out.runs.collect()] == [(3, 0, "success")]
    empty = pipeline.run(pages(spark, "<p>nothing"), SITE)
    assert [(r.items, r.status) for r in empty.runs.collect()] == [(0, "failed")] and [e.code for e in empty.errors.collect()] == ["NO_ITEMS"]


def test_details_page():
    found, named, images, _ = details.page_details("<table><tr><th>Stock #</th><td>K1</td></tr></table><p>Transmission: Auto</p><img class=g src=/a.jpg width=100><img class=g src=/b.jpg>", {"imageSelector": "img.g"})
    assert found["stockId"] == "K1" and found["transmission"] == "Auto" and images == ["/b.jpg"] and not named


def test_details_labels():
    of = lambda html: details.page_details(html, {})[0]
    assert details.known_label(" Engine-Type: ") == "engine type" and details.known_label("STOCK #") == "stock" and details.known_label("colour") == ""
    cut = details.label_and_value
    assert [cut(t) for t in ("Engine: 3.6L V6", "Stock # A7", "Fuel Type Gas", "Engine:", "about us", "x")] == [("engine", "3.6L V6"), ("stock", "A7"), ("fuel", "Type Gas"), ("", ""), ("", ""), ("", "")]
    assert of("<dl><dt>HP</dt><dd>300</dd><dt>Trim</dt><dd>EX</dd></dl>")["horsepower"] == "300"
    assert of("<tr><td>Torque</td><td>1</td></tr><tr><td>Torque</td><td>2</td></tr>")["torque"] == "2"  # the last of a label
    assert of("<strong>Hwy</strong><i>31</i>")["highwayMPG"] == "31" and "cityMPG" not in of("<b>City</b><b>Hwy</b>")
    assert of("<i>Exterior Color: deep blue.</i>")["color"] == "deep blue" and "color" not in of("<style>a{font:Apple Color Emoji}</style>")


def test_details_tiles():
    of = lambda html: details.page_details(html, {})[0]
    got = of("<ul><li>43,100 Miles<li>AWD<li>6 Speed Manual<li>V6<li>Suv<li>21 city MPG<li>hwy mpg 30<li>25 mpg<li>4 cylinders</ul>")
    want = {"mileage": "43,100 miles", "driveType": "AWD", "transmission": "6 Speed Manual", "transmissionType": "Manual", "engine": "V6", "bodyType": "Suv", "cityMPG": "21 MPG", "highwayMPG": "30 MPG", "fuelEconomy": "25 mpg", "cylinders": "4 cylinders"}
    assert {k: got[k] for k in want} == want
    assert "bodyType" not in of("<p>Suv deals</p>") and not of("") and not of(None)


def test_details_replace(spark):
    block = lambda k, v: f"<div class=vdp-info-block__info-item-title>{k}</div><div></div><div class=vdp-info-block__info-item-description>{v}</div>"
    page = block("Engine", "3.6L V6 308hp") + block("Drivetrain", "AWD") + "<table><tr><td>Year</td><td>2020</td></tr></table>"
    given = items(spark, {"url": "u1", "engine": "engineEngine3.6L", "year": "2019"}, {"url": "u2", "driveType": "Drivetrain FWD"}, {"url": "u3", "engine": "old"})
    pages = spark.createDataFrame([("u1", page), ("u2", "<table><tr><td>Drivetrain</td><td>RWD</td></tr></table>"), ("u4", page)], "url string, html string")
    got = {r["url"]: r for r in rows(details.enrich(given, pages, {}), "url")}
    assert (got["u1"]["engine"], got["u1"]["driveType"], got["u1"]["year"]) == ("3.6L V6 308hp", "AWD", "2019")
    assert got["u2"]["driveType"] == "RWD" and got["u3"]["engine"] == "old" and len(got) == 3


def test_paging(spark):
    u = "https://a.test/list?x=1"
    assert one(spark, lambda c: paginate.page_of_urls(F.lit(u), c), "Page 1 of 3") == [["https://a.test/list?PageNumber=2&PageSize=100&x=1", "https://a.test/list?PageNumber=3&PageSize=100&x=1"]]
    assert one(spark, lambda c: paginate.showing_urls(F.lit(u), c), "Showing 1 - 20 of 45", "Showing 1 - 20 of 20") == [["https://a.test/list?Paging.Page=2&x=1", "https://a.test/list?Paging.Page=3&x=1"], []]
    assert one(spark, lambda c: paginate.counted_urls(c, F.lit(3)), "https://a.test/l?page=2&y=1", "https://a.test/l?page=3") == [["https://a.test/l?page=3&y=1"], []]
    assert one(spark, lambda c: paginate.offset_urls(c, F.lit(50), F.lit(20)), "https://a.test/l") == [["https://a.test/l?start=20", "https://a.test/l?start=40"]]
    assert one(spark, lambda c: paginate.zero_based_url(c, F.lit(30), F.lit(10)), "https://a.test/l", "https://a.test/l?ai_page=2") == ["https://a.test/l?ai_page=1", None]
    assert one(spark, lambda c: paginate.elided_urls(c, "p", F.array(*map(F.lit, (2, 3, 6)))), "https://a.test/l?p=2&k=v") == [["https://a.test/l?k=v&p=4", "https://a.test/l?k=v&p=5"]]


def payload(spark, obj):
    return spark.createDataFrame([("r", "https://a.test/inventory", 0, json.dumps(obj)), ("r", "https://a.test/inventory", 1, "not json")], "run_id string, source_url string, page_seq int, payload string")


def test_platforms(spark):
    vin = "1HGCM82633A004352"
    ddc = {"WIS": {"inventory": [{"vin": vin, "stockNumber": "S1", "year": 2020, "make": "A&amp;B", "model": "M", "link": "/v/1", "pricing": {"retailPrice": "$9", "dprice": [{"value": "$8", "isFinalPrice": True}]}, "trackingAttributes": [{"name": "Odometer", "value": "12 miles"}], "images": [{"uri": "u"}]}, {"vin": "x"}]}}
    got = rows(platforms.dealer_dot_com(payload(spark, ddc)), "pos")
    assert [(g["title"], g["price"], g["mileage"], g["images"]) for g in got] == [("2020 A&B M", "$8", "12", ["u"])]
    on = {"DisplayCards": [{"VehicleCard": {"VehicleVin": "V", "VehicleYear": 2021, "VehicleMake": "Kia", "VehicleInternetPrice": 0, "VehicleImageModel": {"VehiclePhotoSrc": "/i.jpg"}, "WasabiVehiclePricingPanelViewModel": {"PriceStakViewModel": {"PriceStakTabsModel": {"BuyContent": "$5 SALE PRICE"}}}}}] * 2}
    got = rows(platforms.dealer_on(payload(spark, on)), "pos")
    assert [(g["title"], g["price"], g["primaryImage"]) for g in got] == [("2021 Kia", "$5", "https://a.test/i.jpg")]
    sync = {"Vehicles": [{"Vin": "", "StockNo": "s1", "Year": "2025", "Make": "Kia", "FinalPrice": 0, "InternetPrice": 7.4, "Mileage": 5, "FirstImageUrl": "//c.test/i.jpg"}, {"StockNo": "S1"}]}
    got = rows(platforms.dealer_sync(payload(spark, sync)), "pos")
    assert [(g["title"], g["price"], g["mileage"], g["primaryImage"]) for g in got] == [("2025 Kia", "$7", "5", "https://c.test/i.jpg")]
    driven = {"props": {"pageProps": {"inventory": {"results": [{"vin": vin, "dealer_id": 2, "price": 1.5}, {"vin": "Z", "dealer_id": 3}, {"vin": "Y", "status": "sold"}, {"vin": "W", "wholesale": 1}]}}}}
    assert [(g["vin"], g["price"]) for g in rows(platforms.driven_motion(payload(spark, driven), 2), "pos")] == [(vin, "2")]
    horne = {"vehicles": [{"year": 2007, "make": "Hyundai", "model": "Santa Fe", "stockNumber": "61-82", "photos": [{"url": "/p"}, {}]}, {"status": "sold"}]}
    assert [(g["url"], g["images"]) for g in rows(platforms.horne_motors(payload(spark, horne)), "pos")] == [("/inventory/2007-hyundai-santa-fe-61-82", ["https://a.test/p"])]
    truck = {"results": [{"hits": [{"id": 5, "make": "Inter National", "model": "D 4", "year": 2017}, {"id": 0}]}]}
    assert [(g["url"], g["stockId"]) for g in rows(platforms.imotor(payload(spark, truck)), "pos")] == [("/used-trucks/for-sale/inter-national/d-4/2017/5/", "5")]
    space = {"vehicles": [{"vin": vin, "make": "Kia", "price": 22995.0, "discountedPrice": 0, "mileage": 1234.0}, {"vin": "v2", "make": "Vw", "price": 0}, {"vin": "v3"}]}
    links = spark.createDataFrame([(vin.lower(), "/a", 0), (vin, "/b", 1)], "vin string, url string, pos int")
    assert [(g["url"], g["price"], g["mileage"]) for g in rows(platforms.space_auto(payload(spark, space), links), "pos")] == [("/b", "$22,995", "1,234"), ("/vehicle/v2/", "", "")]


def test_stores(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, d string")
    out = stores.upsert(table, spark.createDataFrame([("a", 2, "z")], "k string, v int, d string"), ["k"], ["v"])
    assert sorted(map(tuple, out.collect())) == [("a", 2, "z"), ("b", 1, "y")]
    runs = spark.createDataFrame([("scrape-once-cache|x",), ("k",)], "idempotencyKey string")
    assert [r[0] for r in stores.clear_idempotency(runs).collect()] == ["scrape-once-cache|x", ""]


def test_bounded_log(spark):
    events = spark.range(200).select(F.lit(1).alias("log"), F.col("id").alias("at"))
    got = diagnostics.bounded_events(events, ["log"], ["at"]).orderBy("at").collect()
    assert [r["at"] for r in got] == [*range(16), *range(56, 200)] and {r["dropped"] for r in got} == {40}
    assert one(spark, lambda c: diagnostics.bounded_tail(c, 8), "abc\ndefgh\nij", "short") == ["[earlier stderr truncated]\nij", "short"]


def test_strict_listings(spark):
    from gleanery.operators import strict

    page = lambda n, *cars: json.dumps({"page": n, "total_pages": 2, "total": 2, "listings": list(cars)}).replace('"P"', "221995.50")
    car = lambda k: {"vin": f"1HGCM82633A00435{k}", "stock": f"S{k}", "year": 2020, "make": "Kia", "pricing": {"our_price": "P"}, "extra_fields": {"lightning": {"pricing": {"low": {"value": None}}}}}
    given = [("good", 0, page(1, car(1))), ("good", 1, page(2, car(2))), ("bad", 0, page(1, car(1))), ("bad", 1, page(2, car(1)))]
    got, failed = strict.all_or_nothing(strict.listings(spark.createDataFrame(given, "run_id string, page_seq int, payload string")))
    assert [(r.run_id, r.stockId, r.price, r.title) for r in got.orderBy("page_seq").collect()] == [("good", "S1", "221995.50", "2020 Kia"), ("good", "S2", "221995.50", "2020 Kia")]
    assert [r.run_id for r in failed.collect()] == ["bad"]


def test_joined_posts(spark):
    from gleanery.operators import strict

    listed = spark.createDataFrame([("a", 1, "v1"), ("a", 2, "V2"), ("b", 3, "V3")], "run_id string, id int, vin string")
    posts = spark.createDataFrame([(1, "V1", "s1"), (2, "v2", "s2"), (3, "V3", "V3")], "id int, vin string, stock string")
    media = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "parent int, rank int, url string")
    got, failed = strict.joined_posts(listed, posts, media)
    assert [(r.id, r.stock, r.images) for r in got.orderBy("id").collect()] == [(1, "s1", ["x", "y"]), (2, "s2", [])] and [r.run_id for r in failed.collect()] == ["b"]


def test_html_unescape(spark):
    import html
    import random

    from gleanery.functions import text

    rng = random.Random(8)
    parts = ["&amp;", "&amp", "&ampx", "&reg;", "&regx;", "&notit;", "&notin;", "&nbsp;", "&#174;", "&#x1F600;", "&#X41", "&#65x", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#128;", "&#x9f;", "&", "&;", "&#", "&#;", "&#x;", "&unknown;", "&NotEqualTilde;", "&lt", "&CounterClockwiseContourIntegral;", "a b", "é", "\n", "&amp;amp;"]
    cases = [*parts, *("".join(rng.choices(parts, k=6)) for _ in range(300)), "x" * 10_000 + "&lt;" * 2_000]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", text.html_unescape(F.col("c")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: html.unescape(c) for i, c in enumerate(cases)}
