"""Duplicates: what a run leaves on disk, and expressions that the JVM compiles."""

from __future__ import annotations

import re
from pathlib import Path

from gleanery.operators import dedupe, normalize, steps
from gleanery.plans import catalog
from gleanery.plans.samples import items


def test_tables_go_when_the_next_are_written(spark, sf):
    here = Path(steps._shared(spark).removeprefix("file://")) / spark.sparkContext.applicationId
    left = lambda: {p.name for p in here.glob("dedupe-*")}
    before = left()
    out = catalog.QUERIES["dedupe_items_full"](spark, sf)
    made = {n.rsplit("-", 1)[0] for n in left() - before}
    assert made and not made & {"dedupe-keys", "dedupe-rows"}
    assert sum(n.startswith("dedupe-heads") for n in left() - before) == 1  # of the few groups that are merged anew
    assert out.count() == out.count() > 0


def test_the_key_is_compiled(spark, sf):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = dedupe.with_dedupe_key(normalize.normalize(items(spark, sf))).where("key <> ''").select("seq", "key")
        shown = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000  # larger methods are interpreted
