"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the order of (rank - 1 + phase) / rows of the source,
with a hashed phase a source, interleaves all sources in proportion everywhere, and equal cuts of it match the mixture.

Ranks come without one task per source or for all rows: hashes fall into buckets of bounded size, rows are ranked in
their bucket, and bucket offsets are running sums of a small table of counts. Only ids, sizes and hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .mixing import hash_number

BITS = 52


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 29, bucket_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` of every row; shard counts differ by one at most.

    ``size`` is the text's UTF-8 bytes plus one (a null text has none), ``slot`` counts from 0 without gaps in a shard.
    A null source is a source of its own, a null id hashes as empty. Equal rows are interchangeable. Other columns are
    ignored; an empty table gives none. ``row_col``, a number of each row, is returned too if it is named.
    """
    own = [row_col] if row_col else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *own)
    rows = materialize(rows.withColumn("u", hash_number(F.lit(seed), F.col("doc_id"), F.col("text_crc32"))), "shard-rows")
    total = rows.count()
    bits = max(0, (max(1, total) // bucket_rows).bit_length())
    keyed = rows.withColumn("strat", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("bucket", F.shiftright("u", BITS - bits))
    counts = keyed.groupBy("strat", "bucket").agg(F.count("*").alias("c"))
    running = Window.partitionBy("strat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("strat", "bucket", F.coalesce(F.sum("c").over(running), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("strat")).alias("n"))
    place = F.row_number().over(Window.partitionBy("strat", "bucket").orderBy("u", "doc_id", "text_crc32", "size"))
    phase = (hash_number(F.lit(f"{seed} phase"), F.col("strat")) + F.lit(0.5)) / F.lit(float(2**BITS))
    part = (F.col("before") + F.col("place") - 1 + phase) / F.col("n")
    ranked = keyed.withColumn("place", place).join(starts, ["strat", "bucket"]).withColumn("part", part)
    ranked = materialize(ranked.select("doc_id", "source", "size", "text_crc32", *own, "strat", "u", "part", F.floor(F.col("part") * F.lit(float(1 << bits))).cast("long").alias("cell")), "shard-ranks")
    cells = ranked.groupBy("cell").agg(F.count("*").alias("c"))
    # A cell table has a row for every bucket_rows rows of input.
    before = cells.select("cell", F.coalesce(F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("part", "strat", "u", "doc_id", "text_crc32", "size"))
    at = ranked.withColumn("place", place).join(before, "cell").withColumn("at", (F.col("before") + F.col("place") - 1).cast("long"))
    shard = F.expr(f"(at * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # the shard's first place
    return at.withColumn("shard", shard.cast("int")).select("doc_id", "source", "size", "text_crc32", *own, "shard", (F.col("at") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Writes the rows of ``docs`` into ``path/shard=N`` in slot order; each row goes where it was placed, whatever its id.

    Columns ``shard``, ``slot`` and ``sh_row`` of ``docs`` are replaced.
    """
    rows = docs.drop("shard", "slot", "sh_row").withColumn("sh_row", F.monotonically_increasing_id())
    rows = materialize(rows, "shard-input")  # so that a row has one number in both uses
    placed = shard_rows(rows, shards, row_col="sh_row", **options).select("sh_row", "shard", "slot")
    rows = rows.join(placed, "sh_row").drop("sh_row")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
