"""Sets of bands as rows: how each band stores its mask, and what keeps bands from being one set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHAPE = ["width", "height", "depth", "data_type"]


def mask_encodings(pixels: DataFrame, no_data: float | None = None) -> DataFrame:
    """raster_id, band, n_valid, derived and mask_encoding of each band of a set (columns raster_id, band, y, x, dim,
    value, valid; a row for each sample of each band).

    A pixel that is no-data in all dimensions leaves its band's mask (derived). Bands whose given masks are equal share one:
    the first stores it and the others take it over, unless a mask was derived in any band: then each stores its
    own, as where masks differ. A mask of nothing but valid, or invalid, pixels needs no bytes. Masks are compared by
    sums of 64-bit hashes of their valid pixels, whatever the order of rows.
    """
    gone = F.bool_and(F.col("value") == no_data) if no_data is not None else F.lit(False)
    pixel = pixels.groupBy("raster_id", "band", "y", "x").agg(F.bool_and("valid").alias("given"), (F.bool_and("valid") & gone).alias("gone"))
    digest = F.sum(F.when(F.col("given"), F.xxhash64("y", "x").cast("decimal(20,0)")).otherwise(0))
    bands = pixel.groupBy("raster_id", "band").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("given").alias("n_given"), F.count_if(F.col("given") & ~F.col("gone")).alias("n_valid"),
        F.bool_or("gone").alias("derived"), digest.alias("digest"),
    )
    whole, order = Window.partitionBy("raster_id"), Window.partitionBy("raster_id").orderBy("band")
    same = (F.min("digest").over(whole) == F.max("digest").over(whole)) & (F.min("n_given").over(whole) == F.max("n_given").over(whole))
    own = ~same | F.bool_or("derived").over(whole) | (F.row_number().over(order) == 1)
    encoding = F.when(F.col("n_valid") == F.col("pixels"), "None").when(F.col("n_valid") == 0, "ImplicitAllInvalid").when(own, "Explicit").otherwise("External")
    return bands.select("raster_id", "band", "n_valid", "derived", encoding.alias("mask_encoding"))


def set_errors(bands: DataFrame) -> DataFrame:
    """blob_id, n_bands, error_kind and at (the first band at fault; null without an error) of each set.

    bands: blob_id, band, the fields of a header (width, height, depth, data_type, family, version, remaining_band_count) and
    error_kind, as split_bands() or headers tell them. A set is wrong if a band is, if bands differ in shape or type,
    or if a band of version 6 tells of another number of bands behind it than there are. Sound sets are kept.
    """
    order = Window.partitionBy("blob_id").orderBy("band")
    behind = F.count(F.lit(1)).over(order.rowsBetween(1, Window.unboundedFollowing))
    first = F.first(F.struct(*SHAPE)).over(order)
    counted = (F.col("family") == 2) & (F.col("version") >= 6)
    rows = bands.select(
        "blob_id", "band", "error_kind",
        (F.col("error_kind").isNull() & (F.struct(*SHAPE) != first)).alias("differs"),
        F.coalesce(counted & (F.col("remaining_band_count") != behind), F.lit(False)).alias("miscounted"),
    )
    at = lambda c: F.min(F.when(c, F.col("band")))
    found = rows.groupBy("blob_id").agg(
        F.count(F.lit(1)).alias("n_bands"), F.min(F.when(F.col("error_kind").isNotNull(), F.struct("band", "error_kind"))).alias("own"), at(F.col("differs")).alias("differs"), at(F.col("miscounted")).alias("miscounted")
    )
    wrong = F.coalesce(F.col("own.error_kind"), F.when(F.coalesce("differs", "miscounted").isNotNull(), "InvalidBlob"))
    return found.select("blob_id", "n_bands", wrong.alias("error_kind"), F.coalesce("own.band", "differs", "miscounted").alias("at"))


def sound(bands: DataFrame) -> DataFrame:
    """The bands of sets without an error."""
    return bands.join(set_errors(bands).where("error_kind is null").select("blob_id"), "blob_id", "left_semi")
