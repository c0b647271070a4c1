"""Vehicle rows derived from the star-schema tables, the same in Spark and DuckDB, so that item operators have input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEMS_SQL = """
SELECT {place} AS seq,
  CAST(l_suppkey AS STRING) AS dealer_id,
  'https://www.Dealer' || CAST(l_suppkey AS STRING) || '.example/inventory/' AS source_url,
  CASE WHEN l_orderkey % 4 = 0 THEN '' WHEN l_orderkey % 4 = 1 THEN ' Stock #  p' || CAST(l_partkey AS STRING) || ' '
       WHEN l_orderkey % 4 = 2 THEN 'N/A' ELSE 'P' || CAST(l_partkey AS STRING) END AS stock_id,
  CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN ''
       WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN '1hgcm' || lpad(CAST(l_partkey AS STRING), 6, '0') || lpad(CAST(l_orderkey AS STRING), 6, '0')
       ELSE '1HGCM' || lpad(CAST(l_partkey AS STRING), 6, '0') || lpad(CAST(l_suppkey AS STRING), 6, '0') END AS vin,
  CASE WHEN l_linenumber % 5 = 0 THEN '' WHEN l_linenumber % 2 = 0 THEN '/inventory/car-' || CAST(l_partkey AS STRING) || '/?ref=x'
       ELSE 'https://www.Dealer' || CAST(l_suppkey AS STRING) || '.example/inventory/car-' || CAST(l_partkey AS STRING) || '/' END AS url,
  CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 5 = 1 THEN '$' || CAST(1000 + l_partkey AS STRING)
       ELSE ' Used ' || CAST(1995 + l_partkey % 30 AS STRING) || '  ' || CASE WHEN l_partkey % 4 = 0 THEN 'Tesla  Model ' ELSE 'Honda ' END
            || CASE WHEN l_partkey % 2 = 0 THEN 'Y' ELSE 'Civic' END || ' ' || p_type || CASE WHEN l_partkey % 3 = 0 THEN ' Sedan ' ELSE ' SUV' END END AS title,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '$' || CAST(1000 + l_partkey AS STRING) END AS price,
  CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'Mileage: ' || CAST(l_partkey * 7 AS STRING) END AS mileage,
  CASE WHEN l_linenumber % 3 = 1 THEN '/img/' || CAST(l_partkey AS STRING) || '.jpg'
       WHEN l_linenumber % 3 = 2 THEN '/img/logo_' || CAST(l_partkey AS STRING) || '.png' ELSE '' END AS primary_image
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: What numbers the rows, and how many order keys a run of numbers covers.
ORDER, RUN_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax", 4096

ITEMS_ORACLE = ITEMS_SQL.replace("{place}", f"row_number() OVER (ORDER BY {ORDER})").replace("{", "").replace("}", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item rows as sites publish them. ``seq`` numbers them globally: within runs of order keys, after the counts of the
    runs before, which are a row for each run."""
    lines = table(spark, sf_dir, "lineitem").withColumn("run", F.expr(f"l_orderkey div {RUN_KEYS}"))
    counts = lines.groupBy("run").agg(F.count("*").alias("rows"))
    before = counts.select("run", F.coalesce(F.sum("rows").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = lines.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(*ORDER.split(", ")))).join(before, "run")
    return spark.sql(ITEMS_SQL.replace("{place}", "before + place"), lineitem=numbered, part=table(spark, sf_dir, "part"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample under the item schema's names."""
    raw = raw_items(spark, sf_dir)
    return raw.withColumnsRenamed({"stock_id": "stockId", "primary_image": "primaryImage"}).withColumn("images", F.filter(F.array("primaryImage"), lambda i: i != ""))
