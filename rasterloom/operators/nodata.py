"""The value under which no-data is stored, chosen for each raster from its ranges, and its way there and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.codec.model import is_integer, type_range
from rasterloom.codec.writing import SENTINEL_STEPS


def _held(value: Column, data_type: str) -> Column:
    """A double as the type holds it: whole numbers saturate, floats round (beyond their range: infinite)."""
    if is_integer(data_type):
        low, high = type_range(data_type)
        return F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return value.cast("float").cast("double") if data_type == "f32" else value


def sentinel(low: Column, high: Column, original: Column, error: Column, data_type: str) -> Column:
    """struct(bound, encoded): an error bound and a stored sentinel that no lossy value between low and high can be taken for.

    The caller's sentinel stays where it is inside or near the range; then nothing is lossy. Else whole numbers take
    the first value below the range that the type has, or the next above it; floats take the largest of an
    ordered list of candidates that is below all values by more than the bound allows.
    """
    whole = is_integer(data_type)
    least, most = type_range(data_type)
    lossless = F.lit(0.5 if whole else 0.0)
    pair = lambda bound, at: F.struct(bound.cast("double").alias("bound"), at.cast("double").alias("encoded"))
    near = F.floor(error).cast("double") if whole else 2 * error
    inside = original.between(low - near, high + near)
    if whole:
        tried = F.array(pair(error, _held(low - (F.floor(error) + 1), data_type)), pair(lossless, _held(low - 1, data_type)))
        below = F.filter(tried, lambda c: (c["encoded"] >= least) & (c["encoded"] < low))
        above = _held(high + 1, data_type)
        over = F.when((above > high) & (above <= most) & (above < original), pair(lossless, above)).otherwise(pair(lossless, original))
        return F.when(inside, pair(lossless, original)).when(F.size(below) > 0, F.get(below, 0)).otherwise(over)
    steps = [low - 4 * error, *[low - F.lit(d) for d in SENTINEL_STEPS], F.when(low > 0, low / 2).otherwise(low * 2)]
    fit = F.filter(F.array(*[_held(s, data_type) for s in steps]), lambda c: (c > least) & (c < _held(low - 2 * error, data_type)))
    rest = pair(F.when(original >= low, 0.0).otherwise(error), original)
    return F.when(error == 0, pair(error, original)).when(inside, pair(lossless, original)).when(F.size(fit) > 0, pair(error, F.array_max(fit))).otherwise(rest)


def _marked(pixels: DataFrame, value: float) -> DataFrame:
    """Valid samples with there (the sample is no-data) and gone (all of its pixel is)."""
    there = F.col("value") == value
    pixel = Window.partitionBy("raster_id", "y", "x")
    return pixels.where("valid").withColumn("there", there).withColumn("gone", F.bool_and("there").over(pixel))


def choices(pixels: DataFrame, value: float, error: float, data_type: str) -> DataFrame:
    """raster_id, low, high (of samples that are data), bound and encoded of rasters in which some pixels are no-data in
    some dimensions only; others need no sentinel and have no row. error: as effective_error() gives it."""
    data = F.when(~F.col("there"), F.col("value"))
    found = _marked(pixels, value).groupBy("raster_id").agg(F.min(data).alias("low"), F.max(data).alias("high"), F.bool_or(F.col("there") & ~F.col("gone")).alias("mixed"))
    found = found.where("mixed").select("raster_id", "low", "high", sentinel(F.col("low"), F.col("high"), F.lit(float(value)), F.lit(float(error)), data_type).alias("s"))
    return found.select("raster_id", "low", "high", "s.bound", "s.encoded")


def encoded(pixels: DataFrame, value: float, error: float, data_type: str) -> DataFrame:
    """The samples as they are stored: raster_id, y, x, dim, value, and original and sentinel (null where none is needed).
    Pixels that are no-data in all dimensions are left out: they are masked."""
    chosen = choices(pixels, value, error, data_type).select("raster_id", F.col("encoded").alias("sentinel"))
    rows = _marked(pixels, value).where("not gone").join(chosen, "raster_id", "left")
    stored = F.when(F.col("there"), F.coalesce("sentinel", "value")).otherwise(F.col("value"))
    return rows.select("raster_id", "y", "x", "dim", stored.alias("value"), F.when(F.col("sentinel").isNotNull(), F.lit(float(value))).alias("original"), "sentinel")


def decoded(stored: DataFrame) -> DataFrame:
    """The samples of encoded() with their sentinels put back."""
    back = F.when(F.col("value") == F.col("sentinel"), F.col("original")).otherwise(F.col("value"))
    return stored.select("raster_id", "y", "x", "dim", back.alias("value"))
