"""Scheduled jobs: due entries, outcomes of every kind, and a sink that can be written again."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.operators import schedule

ENTRY = "accountID string, dealershipId string, url string, ftp_sync boolean, scrape_sync boolean, spreadsheet_sync boolean, scrapeFrequencyMinutes int, spreadsheetUrl string, schedule struct<type:string>"
ITEMS = "array<struct<stockId:string,stock:string,vin:string,title:string>>"
AT = datetime.datetime(2024, 1, 2, 3, 4, 5)
item = lambda stock, vin="": (stock, "", vin, "t")
BLOCK = ("SCRAPE_RENDER_FAILED", "Blocked by DataDome")
RUNS = {
    "good": (None, [item("S1"), item("s1 "), item("", "V1")], []), "partial": (None, [item("S1")], [("X", "first"), ("Y", "second")]), "empty": (None, [], [("X", "oops")]), "none": (None, [], []), "nostock": (None, [item("", "V1"), item("", "")], []),
    "config": ("no template", [item("S9")], []), "blocked": (None, [], [BLOCK]), "fallback": (None, [], [BLOCK]), "cachedrun": (None, [item("S8")], []), "hollow": (None, [], [BLOCK]),
}
WANT = {
    "good": ("success", 2, ""), "partial": ("partial_success", 1, "first"), "empty": ("failed", 0, "oops"), "none": ("failed", 0, schedule.NO_ITEMS), "nostock": ("success", 1, ""), "config": ("failed", 0, schedule.CONFIG + "no template"), "blocked": ("failed", 0, "Blocked by DataDome"),
    "fallback": ("cached", 2, f"{schedule.USED_AFTER}2024-01-02T03:04:05Z: Blocked by DataDome"), "cachedrun": ("cached", 1, f"{schedule.USED}2024-01-02T03:04:05Z"), "hollow": ("failed", 0, schedule.EMPTY_CACHE), "nocache": ("failed", 0, schedule.NO_CACHE), "norun": ("failed", 0, schedule.UNFINISHED),
}
IMPORTS = {"good": ("success", 2), "partial": ("success", 1), "empty": ("skipped", 0), "none": ("skipped", 0), "nostock": ("skipped", 0), "fallback": ("success", 2), "cachedrun": ("success", 1), "hollow": ("skipped", 0)}


def url(name):
    return f"https://{name}.test/inventory"


@pytest.fixture(scope="module")
def given(spark):
    entries = spark.createDataFrame([("a", "d", url(n), None, None, None, None, None, None) for n in WANT], ENTRY)
    runs = spark.createDataFrame([(url(n), AT, *r) for n, r in RUNS.items()] + [(url("good"), AT - datetime.timedelta(1), None, [], [])], f"url string, at timestamp, config_error string, items {ITEMS}, errors array<struct<code:string,message:string>>")
    cache = spark.createDataFrame([(url("fallback"), AT, [item("F1"), item("F2")]), ("https://www.cachedrun.test/other", AT, [item("C1")]), (url("hollow"), AT, [])], f"source_url string, updated_at timestamp, items {ITEMS}")
    flagged = spark.createDataFrame([(url("cachedrun") + "/",)], "source_url string")
    return entries, runs, cache, flagged, spark.createDataFrame([(url("nocache"),)], "source_url string")


def test_due_entries(spark):
    rows = [
        ("a", "d", "u1", None, None, None, None, None, None), ("a", "d", "u2", None, False, None, None, None, None), ("a", "", "u3", None, True, None, None, None, None), ("a", "d", None, None, None, None, None, None, None),
        ("b", "d", "u5", True, None, True, 10080, "s", ("daily",)), ("b", "d", "u6", True, None, True, 60, " ", ("weekly",)), (" ", "d", "u7", True, None, None, None, None, (" Weekly ",)), ("c", "d", "u8", None, False, True, 0, "s", ("monthly",)),
    ]
    df = spark.createDataFrame(rows, ENTRY)
    assert sorted(r.url for r in schedule.due(df, "daily").collect()) == ["u1", "u6"] and sorted(r.url for r in schedule.due(df, "weekly").collect()) == ["u5", "u7"]
    assert sorted(map(tuple, schedule.source_syncs(df, "daily").collect())) == [("b", "files"), ("b", "spreadsheet"), ("c", "spreadsheet")] and sorted(map(tuple, schedule.source_syncs(df, "weekly").collect())) == [("b", "files")]
    assert [r[0] for r in spark.createDataFrame([("manual",), ("x",), (None,)], "t string").select(schedule.trigger(F.col("t"))).collect()] == ["manual", "service", "service"]


def test_outcomes(given):
    out = schedule.outcomes(*given, "daily-upsert", "daily")
    events = out.activity.collect()
    assert {r.sourceUrl.split("/")[2][:-5]: (r.status, r.itemCount, r.message) for r in events if r.phase == "scrape"} == WANT
    assert {r.sourceUrl.split("/")[2][:-5]: (r.status, r.itemCount) for r in events if r.phase == "import"} == IMPORTS
    assert {r.message for r in events if r.status == "skipped"} == {schedule.NO_STOCK}
    results = {r.sourceUrl.split("/")[2][:-5]: r for r in out.results.collect()}
    assert {n: r.status for n, r in results.items() if r.status != "success"} == {"partial": "partial_success", "empty": "partial_success"} | dict.fromkeys(("config", "blocked", "nocache", "norun"), "failed")
    assert results["config"].failureReason == schedule.CONFIG + "no template" and results["empty"].errorCount == 1 and results["fallback"].errorCount == 0
    assert sorted((r.sourceUrl.split("/")[2][:-5], r.stockId) for r in out.inventory.collect()) == [("cachedrun", "C1"), ("fallback", "F1"), ("fallback", "F2"), ("good", "S1"), ("good", "s1 "), ("partial", "S1")]
    assert sorted(r.source_url for r in out.flagged.collect()) == sorted(map(url, ("blocked", "fallback", "hollow"))) and len({r.id for r in events}) == len(events)


def test_sink_repeats_safely(spark, given, tmp_path):
    base = f"file://{tmp_path}/sink"
    entries, runs, cache, flagged, only = given
    names = ("inventory", "results", "activity", "flagged")
    of = lambda runs: schedule.outcomes(entries, runs, cache, flagged, only, "job", "daily")
    shown = lambda: {n: sorted(map(str, schedule.view(spark, base, n).collect())) for n in names}
    schedule.write_batch(of(runs), base, 0)
    first = shown()
    assert first["inventory"] and first["activity"]
    schedule.write_batch(of(runs), base, 0)
    assert shown() == first
    later = runs.where(F.col("url") == url("good")).withColumns({"at": F.col("at") + F.expr("interval 1 day"), "items": F.slice("items", 1, 1)})
    schedule.write_batch(of(later), base, 1)
    second = shown()
    assert len(second["inventory"]) == len(first["inventory"]) and second["results"] != first["results"]
    schedule.write_batch(of(later), base, 1)
    assert shown() == second
    of(runs).inventory.write.parquet(f"{base}/inventory/batch=2")  # a batch that was cut off before its mark
    assert shown() == second


def test_stream_of_runs_into_the_sink(spark, given, tmp_path):
    entries, runs, cache, flagged, only = given
    landed, base = f"file://{tmp_path}/landed", f"file://{tmp_path}/sink"
    for names in (["good", "blocked"], ["partial"]):
        runs.where(F.col("url").isin(*map(url, names))).coalesce(1).write.mode("append").parquet(landed)

    def write(batch, number):
        due = entries.join(batch.select("url").distinct(), "url", "left_semi")
        schedule.write_batch(schedule.outcomes(due, batch, cache, flagged, only, "job", "daily"), base, number)

    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    for _ in range(2):  # the second start finds nothing new
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sourceUrl for r in schedule.view(spark, base, "results").collect()) == sorted(map(url, ("good", "blocked", "partial")))
    assert [r.source_url for r in schedule.view(spark, base, "flagged").collect()] == [url("blocked")]
