"""Syncs, upserts and crawl limits of requests of every kind."""

from __future__ import annotations

from gleanery.operators import ingest

ITEMS = "array<struct<stockId:string,stock:string,vin:string>>"


def test_syncs(spark):
    entries = spark.createDataFrame([(2, "https://a.test/used", "d2", "a2"), (1, "https://A.test/used/", "d1", "a1"), (3, "https://b.test/", "", "a3")], "seq int, url string, dealershipId string, accountID string")
    one, none = [("S", "", "v"), ("", "T", ""), ("", "", "v")], [("", "", "v")]
    rows = [
        (1, "https://a.test/used#x", 1, "", None, None, one), (2, "https://a.test/used", 2, "own", "", False, one), (3, "https://a.test/used", 3, "own", "own", True, one), (4, "https://b.test/", 1, "", "", False, one), (5, "https://b.test/", 2, "d", "", False, none),
        (6, "not a url", 1, "d", "a", False, one), (7, None, 1, "d", "a", True, one), (8, "https://c.test/x", 1, "d", "a", False, None),
    ]
    got = ingest.sync_requests(spark.createDataFrame(rows, f"id int, url string, at int, dealershipId string, accountID string, skipUpsert boolean, items {ITEMS}"), entries)
    said = {r.id: (r.code, r.dealershipId, r.accountID, r.cachedItems, r.upserted) for r in got.responses.collect()}
    assert said == {1: ("", "d1", "a1", 2, True), 2: ("", "own", "a1", 2, True), 3: ("", "", "", 2, False), 4: ("", "", "a3", 2, False), 5: ("", "d", "a3", 0, False), 6: ("INVALID_REQUEST", "d", "a", 0, False), 7: ("INVALID_REQUEST", "", "", 0, False), 8: ("", "d", "a", 0, False)}
    assert sorted((r.id, r.stockId, r.pos) for r in got.inventory.collect()) == [(1, "", 1), (1, "S", 0), (2, "", 1), (2, "S", 0)]
    assert [r.source_url for r in got.flagged.collect()] == ["https://a.test/used"] and got.cached.count() == 6
    cache = spark.createDataFrame([("https://a.test/used/", "old", "", 0, none), ("https://z.test/", "z", "", 0, none)], f"source_url string, dealershipId string, accountID string, updated_at int, items {ITEMS}")
    held = {r.source_url: (r.updated_at, len(r["items"] or [])) for r in ingest.apply_syncs(cache, got.cached).collect()}
    assert held["https://a.test/used"] == (3, 2) and held["https://z.test/"] == (0, 1) and held["https://b.test/"] == (2, 0) and len(held) == 4


def test_upserts(spark):
    rows = [(1, "a", "d", "manual", [("S", "", ""), ("", "T", "")]), (2, "", "d", "x", [("S", "", "")]), (3, "a", None, None, [("S", "", "")]), (4, "a", "d", "signup", [("", "T", "")]), (5, "a", "d", None, None)]
    inventory, said = ingest.upsert_requests(spark.createDataFrame(rows, f"id int, accountID string, dealershipId string, activityTrigger string, items {ITEMS}"))
    assert [(r.id, r.stockId) for r in inventory.collect()] == [(1, "S")]
    got = {r.id: (r.status, r.message, r["count"], r.trigger) for r in said.collect()}
    assert got[1] == ("ok", "", 1, "manual") and got[2] == ("INVALID_REQUEST", ingest.NO_OWNER, 0, "service") and got[3][1] == ingest.NO_OWNER and got[4] == ("INVALID_REQUEST", ingest.NO_ROWS, 0, "signup") and got[5] == ("INVALID_REQUEST", ingest.NO_ROWS, 0, "service")


def test_crawl_limits(spark):
    df = spark.createDataFrame([(1, 0, None, 3, 5, None, None, None, None), (2, 7, 8, 9, None, 1, 0, 2, 4)], "id int, maxPages int, scrollMaxAttempts int, clickMaxAttempts int, maxItems int, optPages int, optScrolls int, optClicks int, optItems int")
    assert sorted(map(tuple, ingest.with_crawl_limits(df, 20, 30, 40).collect())) == [(1, 20, 30, 3, 5), (2, 1, 8, 2, 4)]
