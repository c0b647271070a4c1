"""Landed pages as a stream: each micro-batch goes through the batch operators into keyed tables. An addition; the
operators themselves are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import urls
from ..operators import stores


def landed(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def keyed_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"key": urls.canonical_key(F.col("url")), "host": urls.host_key(F.col("url"))})


def host_counts(pages: DataFrame, at: str, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Pages by host and window of ``at``; rows later than the watermark are dropped by the engine."""
    return keyed_pages(pages).withWatermark(at, late).groupBy(F.window(at, every), "host").agg(F.count("*").alias("pages"))


def keep_latest(pages: DataFrame, table: str, checkpoint: str, version: str = "page_id") -> StreamingQuery:
    """Keeps the latest row of each URL key under ``table/v=N``; a batch that is retried writes its version anew."""

    def write(batch: DataFrame, number: int) -> None:
        new = keyed_pages(batch)
        old = batch.sparkSession.read.parquet(f"{table}/v={number - 1}") if number else new.limit(0)
        stores.upsert(old, new, ["key"], [version]).write.mode("overwrite").parquet(f"{table}/v={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
