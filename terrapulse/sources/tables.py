"""Observations out of the driver's tables: affine maps of line items, a series a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.functions.scalars import ordinal

#: The same expressions in Spark SQL and in the oracle's SQL.
BANDS_SQL = {
    "blue": "l_extendedprice / 10 - 200",
    "green": "l_quantity * 200 + 100",
    "red": "l_extendedprice / 12",
    "nir": "l_quantity * 150 + l_discount * 20000",
    "swir1": "l_tax * 50000 + 1000",
    "swir2": "l_discount * 90000 + 500",
    "thermal": "2700 + 4 * l_quantity",
}
QA_SQL = """CASE l_suppkey % 3
  WHEN 0 THEN CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 2 ELSE 255 END
  WHEN 1 THEN CASE WHEN l_linenumber <= 5 THEN 3 WHEN l_linenumber = 6 THEN 4 ELSE 0 END
  ELSE CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 3 ELSE 255 END END"""
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel_id, seq, day, seven bands, qa."""
    # The series is named before the window, so that the exchange by it serves later windows by pixel too.
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("pixel_id", F.col("l_suppkey"))
    place = F.row_number().over(Window.partitionBy("pixel_id").orderBy(*ORDER)).cast("long")
    bands = [F.expr(f"CAST({e} AS DOUBLE)").alias(b) for b, e in BANDS_SQL.items()]
    return lines.select("pixel_id", place.alias("seq"), ordinal(F.col("l_shipdate")).alias("day"), *bands, F.expr(QA_SQL).cast("int").alias("qa"))


#: The oracle's observations, as the first tables of a WITH.
OBS_SQL = f"""obs AS (
  SELECT l_suppkey AS pixel_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(ORDER)}) AS seq,
    (date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 719163)::BIGINT AS day,
    {", ".join(f"CAST({e} AS DOUBLE) AS {b}" for b, e in BANDS_SQL.items())}, ({QA_SQL})::INTEGER AS qa
  FROM lineitem
)"""
