"""Tasks follow the rows of a table, not the session's number of shuffle partitions."""

from __future__ import annotations

from gleanery.operators import steps
from gleanery.plans import catalog


def test_strict_snapshot_is_dealt_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(steps, "TASK_ROWS", 500, raising=False)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert catalog.QUERIES["strict_snapshot"](spark, sf).rdd.getNumPartitions() == -(-rows // 500) > 4
