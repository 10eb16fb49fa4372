"""Rasters made of tables with a dense key: strips of bounded height, a row for each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a strip. A strip is one raster, so that no raster grows with its table.
STRIP = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_key(df: DataFrame, key: str, width: int, values: list[Column], valid: Column | None = None, strip: int = STRIP, keep: tuple[str, ...] = ()) -> DataFrame:
    """raster_id, y, x, dim, value, valid: key // width is the row of all strips, key % width the column."""
    row = F.floor(F.col(key) / width)
    value = F.posexplode(F.array(*[v.cast("double") for v in values])).alias("dim", "value")
    ok = F.lit(True) if valid is None else valid
    return df.select(F.floor(row / strip).alias("raster_id"), (row % strip).cast("int").alias("y"), (F.col(key) % width).cast("int").alias("x"), ok.alias("valid"), *keep, value)


def events(spark: SparkSession, sf_dir: str, strip: int = STRIP) -> DataFrame:
    return from_key(table(spark, sf_dir, "events"), "event_id", 100, [F.col("value")], F.col("event_type") != "error", strip)


def order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_key(table(spark, sf_dir, "orders"), "o_orderkey", 150, [F.col("o_custkey")])


def order_prices(spark: SparkSession, sf_dir: str, strip: int = STRIP) -> DataFrame:
    """Two dimensions: price and customer."""
    return from_key(table(spark, sf_dir, "orders"), "o_orderkey", 150, [F.col("o_totalprice"), F.col("o_custkey")], strip=strip)


def order_pairs(spark: SparkSession, sf_dir: str, strip: int = STRIP) -> DataFrame:
    """Two whole-number dimensions that are near each other: customer, and customer plus the key's last digit."""
    return from_key(table(spark, sf_dir, "orders"), "o_orderkey", 150, [F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey") % 10], strip=strip)


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_key(table(spark, sf_dir, "part"), "p_partkey", 20, [F.col("p_size")])


def embeddings(spark: SparkSession, sf_dir: str, depth: bool = False) -> DataFrame:
    """A matrix of 64 columns; or, with depth, one column of pixels with 64 dimensions."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    place = [F.lit(0).alias("x"), F.col("k").alias("dim")] if depth else [F.col("k").alias("x"), F.lit(0).alias("dim")]
    return df.select(F.floor(F.col("vec_id") / STRIP).alias("raster_id"), (F.col("vec_id") % STRIP).cast("int").alias("y"), *place, F.col("v").cast("double").alias("value"), F.lit(True).alias("valid"))


def event_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band for each event type, in alphabetical order; a pixel is valid in its own type's band."""
    types = ["click", "error", "purchase", "signup", "view"]
    df = table(spark, sf_dir, "events")
    return from_key(df.withColumn("band", F.explode(F.array(*map(F.lit, range(len(types)))))), "event_id", 100, [F.col("value")], F.col("event_type") == F.element_at(F.array(*map(F.lit, types)), F.col("band") + 1), keep=("band",))
