"""The whole extraction: landed pages and details under a template to items, errors and run rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, details, extract, inventory, normalize


@dataclass(frozen=True)
class Result:
    items: DataFrame
    errors: DataFrame
    runs: DataFrame


def run(pages: DataFrame, site: dict, detail_pages: DataFrame | None = None, dealer_id: str = "", cap: int = 0, image_sizes: DataFrame | None = None) -> Result:
    """Extract, normalise, alias, dedupe, enrich, dedupe again, validate, count, derive the status.

    ``pages`` is ``run_id, page_seq, url, html``. Order within a run is (page, extractor, position).
    ``image_sizes`` (url, w, h) drops small images of detail pages.
    """
    place = F.shiftleft(F.col("page_seq").cast("long"), 36) + F.shiftleft(F.col("extractor").cast("long"), 33) + F.col("pos")  # unique and ascending in a run, without a sort of it
    rows = extract.extract(pages, site).withColumns({"dealer_id": F.lit(dealer_id), "seq": place})
    first = pages.groupBy("run_id").agg(F.min_by("url", "page_seq").alias("site_url"))
    ready = normalize.aliases(normalize.normalize(rows)).join(first, "run_id").withColumn("website", F.col("site_url")).drop("site_url")
    items = dedupe.dedupe(ready, ["run_id"])
    if detail_pages is not None:
        based = details.enrich(items, detail_pages, site.get("detailPage", {}), image_sizes).withColumns({"source_url": F.col("website"), "dealer_id": F.lit(dealer_id)})
        items = dedupe.dedupe(normalize.aliases(normalize.normalize(based)), ["run_id"])
    if cap:
        items = inventory.capped(items, ["run_id"], cap)
    good = items.where(inventory.is_credible())
    all_runs = pages.select("run_id").distinct()
    counts = all_runs.join(good.groupBy("run_id").agg(F.count("*").alias("items")), "run_id", "left").fillna(0, ["items"])
    errors = inventory.run_errors(inventory.invalid_errors(items, ["run_id"]), counts, ["run_id"])
    failed = errors.groupBy("run_id").agg(F.count("*").alias("errors"))
    runs = counts.join(failed, "run_id", "left").fillna(0, ["errors"]).withColumn("status", inventory.run_status(F.col("items"), F.col("errors")))
    return Result(good, errors, runs)
