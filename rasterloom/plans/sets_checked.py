"""Queries over no-data sentinels, masks of sets, and sets that are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.codec import writing
from rasterloom.functions import blobs, headers
from rasterloom.operators import nodata, sets
from rasterloom.plans.queries import EVENTS, query
from rasterloom.sources import rasters

# Orders in rasters of 10 columns and 16 rows and two dimensions; no-data lies below, above or within the values.
_ND_SENTINEL = -9999.0
_ND_VALUE = "CASE o_orderkey // 160 % 4 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN -9000 - o_custkey % 300 * 10.0 WHEN 2 THEN -20000.5 - o_custkey ELSE o_custkey / 8.0 - 10005 END"
_ND_ROWS = (
    "(SELECT o_orderkey // 160 AS raster_id, CAST(o_orderkey % 160 // 10 AS INT) AS y, CAST(o_orderkey % 10 AS INT) AS x, CAST(d AS INT) AS dim, "
    f"CASE WHEN o_custkey % 7 = 0 OR d = 1 AND o_custkey % 5 = 0 AND o_orderkey // 160 % 9 <> 8 THEN {_ND_SENTINEL} ELSE {_ND_VALUE} END AS value FROM orders, range(2) t(d))"
)


def _nd(spark, sf_dir) -> DataFrame:
    value = F.expr(_ND_VALUE.replace("//", "DIV"))
    gone, some = F.col("o_custkey") % 7 == 0, (F.col("o_custkey") % 5 == 0) & (F.expr("o_orderkey DIV 160 % 9") != 8)
    df = rasters.table(spark, sf_dir, "orders")
    return rasters.from_key(df, "o_orderkey", 10, [F.when(gone, _ND_SENTINEL).otherwise(value), F.when(gone | some, _ND_SENTINEL).otherwise(value)], strip=16)


_ND_PIXELS = f"(SELECT *, value = {_ND_SENTINEL} AS there, bool_and(value = {_ND_SENTINEL}) OVER (PARTITION BY raster_id, y, x) AS gone FROM {_ND_ROWS})"


def _sentinel_sql(error: float, kind: str) -> str:
    held = "CAST(CAST({0} AS FLOAT) AS DOUBLE)" if kind == "f32" else "{0}"
    steps = ", ".join(held.format(f"(low - CAST({s!r} AS DOUBLE))") for s in (4 * error, *writing.SENTINEL_STEPS))
    steps += ", " + held.format("(CASE WHEN low > 0 THEN low / 2 ELSE low * 2 END)")
    return f"""
SELECT raster_id, CAST({error} AS DOUBLE) AS error, low, high, CASE WHEN {_ND_SENTINEL} BETWEEN low - {2 * error} AND high + {2 * error} THEN 0 WHEN len(fit) > 0 THEN {error} WHEN {_ND_SENTINEL} >= low THEN 0 ELSE {error} END::DOUBLE AS bound,
       CASE WHEN {_ND_SENTINEL} BETWEEN low - {2 * error} AND high + {2 * error} OR len(fit) = 0 THEN {_ND_SENTINEL} ELSE list_max(fit) END::DOUBLE AS encoded
FROM (SELECT *, list_filter([{steps}], lambda c: c < {held.format(f'(low - {2 * error})')}) AS fit FROM
      (SELECT raster_id, min(value) FILTER (WHERE NOT there) AS low, max(value) FILTER (WHERE NOT there) AS high FROM {_ND_PIXELS} GROUP BY raster_id HAVING bool_or(there AND NOT gone)))"""


_ERRORS = (0.25, 3.0, 40.0)


@query(" UNION ALL ".join(_sentinel_sql(e, "f64") for e in _ERRORS))
def sentinel_choice(spark, sf_dir):
    """The stored sentinel of each raster of doubles, for several error bounds."""
    found = [nodata.choices(_nd(spark, sf_dir), _ND_SENTINEL, e, "f64").withColumn("error", F.lit(e)) for e in _ERRORS]
    return reduce(DataFrame.unionByName, found).select("raster_id", "error", "low", "high", "bound", "encoded")


@query(_sentinel_sql(3.0, "f32").replace("min(value)", "min(CAST(CAST(value AS FLOAT) AS DOUBLE))").replace("max(value)", "max(CAST(CAST(value AS FLOAT) AS DOUBLE))"))
def sentinel_choice_f32(spark, sf_dir):
    pixels = _nd(spark, sf_dir).withColumn("value", F.col("value").cast("float").cast("double"))
    return nodata.choices(pixels, _ND_SENTINEL, 3.0, "f32").select("raster_id", F.lit(3.0).alias("error"), "low", "high", "bound", "encoded")


@query(f"SELECT raster_id, y, x, dim, value FROM {_ND_PIXELS} WHERE NOT gone")
def sentinel_round_trip(spark, sf_dir):
    """Samples stored under their raster's sentinel, and put back."""
    return nodata.decoded(nodata.encoded(_nd(spark, sf_dir), _ND_SENTINEL, 3.0, "f64"))


@query(
    f"SELECT raster_id, CAST(coalesce(bound, 3.0) AS DOUBLE) AS max_z_error, CASE WHEN bound IS NULL THEN 4 ELSE 6 END::INT AS version, CASE WHEN bound IS NOT NULL THEN {_ND_SENTINEL} END::DOUBLE AS no_data_value "
    f"FROM (SELECT DISTINCT raster_id FROM {_ND_ROWS}) LEFT JOIN ({_sentinel_sql(3.0, 'f64')}) USING (raster_id) WHERE bound IS NOT NULL"
)
def sentinel_headers(spark, sf_dir):
    """The bound, version and sentinel in the headers of real blobs with mixed pixels."""
    made = blobs.encode(_nd(spark, sf_dir), "f64", writing.Options(3.0, 8, _ND_SENTINEL))
    found = made.select(F.col("blob_id").alias("raster_id"), headers.header(F.col("content")).alias("h")).where("h.version = 6")
    return found.select("raster_id", "h.max_z_error", "h.version", "h.no_data_value")


# Sets of three bands of two dimensions: by set, one shared mask, none, masks that differ, or a band with no-data in whole pixels.
_SET_VALID = "CASE event_id // 400 % 5 WHEN 0 THEN event_id % 3 > 0 WHEN 1 THEN true WHEN 2 THEN event_id % 3 > band % 2 WHEN 3 THEN event_id % 4 > 0 ELSE false END"
_SET_VALUE = "CASE WHEN event_id // 400 % 5 IN (1, 3) AND event_id // 2000 % 2 = 1 AND band = 1 AND event_id % 7 = 1 THEN -1.0 ELSE event_id % 50 + band END"
_SETS = (
    "(SELECT event_id // 400 AS raster_id, CAST(band AS INT) AS band, CAST(event_id % 400 // 20 AS INT) AS y, CAST(event_id % 20 AS INT) AS x, CAST(d AS INT) AS dim, "
    f"CAST({_SET_VALUE} AS DOUBLE) AS value, {_SET_VALID} AS valid FROM events, range(3) b(band), range(2) t(d))"
)


def _sets(spark, sf_dir) -> DataFrame:
    df = rasters.table(spark, sf_dir, "events").withColumn("band", F.explode(F.array(*map(F.lit, range(3)))))
    value = F.expr(_SET_VALUE.replace("//", "DIV"))
    return rasters.from_key(df, "event_id", 20, [value, value], F.expr(_SET_VALID.replace("//", "DIV")), strip=20, keep=("band",))


_POLICY = f"""
WITH p AS (SELECT raster_id, band, y, x, bool_and(valid) AS given, bool_and(valid) AND bool_and(value = -1) AS gone FROM {_SETS} GROUP BY ALL),
b AS (SELECT raster_id, band, count(*) AS pixels, count(*) FILTER (WHERE given AND NOT gone) AS n_valid, bool_or(gone) AS derived, coalesce(string_agg(y || ',' || x, ';' ORDER BY y, x) FILTER (WHERE given), '') AS mask FROM p GROUP BY ALL),
s AS (SELECT raster_id, count(DISTINCT mask) = 1 AS same, bool_or(derived) AS any_derived FROM b GROUP BY raster_id)
SELECT raster_id, band, n_valid, CASE WHEN n_valid = pixels THEN 'None' WHEN n_valid = 0 THEN 'ImplicitAllInvalid' WHEN NOT same OR any_derived OR band = 0 THEN 'Explicit' ELSE 'External' END AS mask_encoding FROM b JOIN s USING (raster_id)"""


@query(_POLICY)
def mask_policy(spark, sf_dir):
    """How each band of a set stores its mask."""
    return sets.mask_encodings(_sets(spark, sf_dir), -1.0).select("raster_id", "band", "n_valid", "mask_encoding")


@query(_POLICY)
def mask_policy_headers(spark, sf_dir):
    """The same, from the headers of real sets."""
    made = blobs.split_bands(blobs.encode_bands(_sets(spark, sf_dir), "i32", writing.Options(0.5, 8, -1.0)))
    return made.select(F.col("blob_id").alias("raster_id"), "band", F.col("valid_pixel_count").alias("n_valid"), "mask_encoding")


_SET_IDS = "(SELECT DISTINCT event_id // 400 AS raster_id FROM events)"


@query(
    "SELECT raster_id, CASE raster_id % 5 WHEN 1 THEN 2 WHEN 4 THEN 2 ELSE 3 END::BIGINT AS n_bands, CASE raster_id % 5 WHEN 0 THEN NULL WHEN 4 THEN 'InvalidMagic' ELSE 'InvalidBlob' END AS error_kind, "
    f"CASE raster_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 1 END::INT AS at FROM {_SET_IDS}"
)
def set_errors(spark, sf_dir):
    """Sets of bands that count down, some damaged: without their last band, with two bands changed about, with a band of
    another shape, or with junk behind the first band."""
    rows = _sets(spark, sf_dir).withColumn("valid", F.lit(True)).withColumn("value", F.when((F.col("dim") == 1) & ((F.col("x") + F.col("y")) % 2 == 0), -1.0).otherwise(F.col("x") + F.col("band")))
    bands = blobs.split_bands(blobs.encode_bands(rows, "i32", writing.Options(0.5, 8, -1.0))).select("blob_id", "band", "content")
    kind = F.col("blob_id") % 5
    narrow = rows.where("x < 10 and band = 1").select("raster_id", F.lit(0).alias("band"), "y", "x", "dim", "value", "valid")
    other = blobs.encode(narrow, "i32", writing.Options(0.5, 8, -1.0)).select("blob_id", F.col("content").alias("other"))
    found = bands.join(other, "blob_id").where(~((kind == 1) & (F.col("band") == 2)) & ~((kind == 4) & (F.col("band") == 2)))
    junk = F.lit(bytearray(b"junk and more junk"))
    content = F.when((kind == 3) & (F.col("band") == 1), F.col("other")).when((kind == 4) & (F.col("band") == 1), junk).otherwise(F.col("content"))
    place = F.when((kind == 2) & (F.col("band") < 2), 1 - F.col("band")).otherwise(F.col("band"))
    told = found.select("blob_id", place.alias("band"), headers.header(content).alias("h")).select("blob_id", "band", "h.*")
    return sets.set_errors(told).select(F.col("blob_id").alias("raster_id"), "n_bands", "error_kind", "at")


_EVENT_TYPES = "(VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) t(band, type)"


@query(
    f"SELECT raster_id, any_value(h) AS height, any_value(w) AS width, CAST(5 AS INT) AS bands, string_agg(CASE WHEN event_type = type THEN '01' ELSE '00' END, '' ORDER BY y, x, band) AS masks "
    f"FROM (SELECT *, max(y) OVER (PARTITION BY raster_id) + 1 AS h, max(x) OVER (PARTITION BY raster_id) + 1 AS w FROM {EVENTS}), {_EVENT_TYPES} GROUP BY raster_id"
)
def set_masks(spark, sf_dir):
    """The masks of all bands of a set, without their samples."""
    found = blobs.set_masks(blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64"))
    return found.select(F.col("blob_id").alias("raster_id"), F.col("shape")[0].alias("height"), F.col("shape")[1].alias("width"), F.col("shape")[2].alias("bands"), F.hex("masks").alias("masks"))
