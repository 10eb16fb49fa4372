"""Queries over the driver's tables, and the SQL that says the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.codec import writing
from rasterloom.codec.bits import NARROWER
from rasterloom.codec.model import dtype, type_range
from rasterloom.functions import blobs, headers
from rasterloom.operators import tiles
from rasterloom.sources import ranges, rasters, shared
from rasterloom.sources.datasource import RasterSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_KEYED = "SELECT {key} // {width} // 256 AS raster_id, CAST(({key} // {width}) % 256 AS INT) AS y, CAST({key} % {width} AS INT) AS x"
EVENTS = f"({_KEYED.format(key='event_id', width=100)}, CAST(0 AS INT) AS dim, value, event_type <> 'error' AS valid, event_type, event_id FROM events)"
ORDERS = f"({_KEYED.format(key='o_orderkey', width=150)}, CAST(0 AS INT) AS dim, CAST(o_custkey AS DOUBLE) AS value, true AS valid FROM orders)"
PARTS = f"({_KEYED.format(key='p_partkey', width=20)}, CAST(0 AS INT) AS dim, CAST(p_size AS DOUBLE) AS value, true AS valid FROM part)"
#: The same with strips of 8 rows, so that small tables are many rasters.
_KEYED_8 = _KEYED.replace("256", "8")
EVENTS_8 = EVENTS.replace("256", "8")
BLOCKS = "y // 8 AS by, x // 8 AS bx"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round_trip(pixels: DataFrame, data_type: str, options: writing.Options = writing.Options()) -> DataFrame:
    """Valid samples after encoding and decoding."""
    found = blobs.pixels(blobs.encode(pixels, data_type, options)).where("valid")
    return found.select(F.col("blob_id").alias("raster_id"), "y", "x", "dim", "value")


@query(f"SELECT raster_id, y, x, dim, value FROM {EVENTS} WHERE valid")
def decode_lossless_f64(spark, sf_dir):
    return _round_trip(rasters.events(spark, sf_dir), "f64")


@query(f"SELECT raster_id, y, x, dim, value FROM {ORDERS}")
def decode_lossless_i32(spark, sf_dir):
    return _round_trip(rasters.order_customers(spark, sf_dir), "i32")


@query(f"SELECT raster_id, y, x, dim, value FROM {PARTS}")
def decode_huffman_u8(spark, sf_dir):
    return _round_trip(rasters.part_sizes(spark, sf_dir), "u8", writing.Options(0.5))


_EMB = "SELECT vec_id // 256 AS raster_id, CAST(vec_id % 256 AS INT) AS y, CAST({x} AS INT) AS x, CAST({d} AS INT) AS dim, CAST(embedding[k + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(k)"


@query(_EMB.format(x="k", d="0"))
def decode_one_sweep(spark, sf_dir):
    return _round_trip(rasters.embeddings(spark, sf_dir), "f32")


@query(_EMB.format(x="0", d="k"))
def decode_depth64(spark, sf_dir):
    return _round_trip(rasters.embeddings(spark, sf_dir, depth=True), "f32")


@query(f"SELECT raster_id, count(*) AS n, CAST(0 AS BIGINT) AS beyond FROM {EVENTS} WHERE valid GROUP BY raster_id")
def decode_lossy_bounded(spark, sf_dir):
    """Samples that come back beyond the bound: none."""
    source = rasters.events(spark, sf_dir).where("valid")
    back = _round_trip(rasters.events(spark, sf_dir), "f64", writing.Options(0.5)).withColumnRenamed("value", "back")
    both = source.join(back, ["raster_id", "y", "x", "dim"], "left")
    beyond = F.coalesce(F.abs(F.col("value") - F.col("back")) > 0.5 + 1e-9, F.lit(True))
    return both.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(beyond).alias("beyond"))


@query(
    f"SELECT raster_id, CAST(100 AS BIGINT) AS width, max(y) + CAST(1 AS BIGINT) AS height, count(*) FILTER (WHERE valid) AS valid_pixel_count, min(value) FILTER (WHERE valid) AS z_min, "
    f"max(value) FILTER (WHERE valid) AS z_max, 'f64' AS data_type, CASE WHEN bool_and(valid) AND count(*) % 100 = 0 THEN 'None' ELSE 'Explicit' END AS mask_encoding FROM {EVENTS} GROUP BY raster_id"
)
def inspect_header(spark, sf_dir):
    found = blobs.encode(rasters.events(spark, sf_dir), "f64").withColumn("i", blobs.inspect(F.col("content")))
    return found.select(F.col("blob_id").alias("raster_id"), *[f"i.{c}" for c in ("width", "height", "valid_pixel_count", "z_min", "z_max", "data_type", "mask_encoding")])


_PRICES = f"({_KEYED_8.format(key='o_orderkey', width=150)}, o_totalprice AS price, o_custkey AS customer FROM orders)"


@query(
    f"SELECT raster_id, CAST(2 AS INT) AS family, CAST(4 AS INT) AS version, 'f64' AS data_type, CAST(100 AS BIGINT) AS width, max(y) + CAST(1 AS BIGINT) AS height, CAST(1 AS BIGINT) AS depth, "
    f"count(*) FILTER (WHERE valid) AS valid_pixel_count, CAST(0 AS INT) AS remaining_band_count, CAST(0 AS DOUBLE) AS max_z_error, min(value) FILTER (WHERE valid) AS z_min, max(value) FILTER (WHERE valid) AS z_max, "
    f"CASE WHEN bool_and(valid) AND count(*) % 100 = 0 THEN 'None' ELSE 'Explicit' END AS mask_encoding, CAST(NULL AS DOUBLE) AS no_data_value, CAST(NULL AS VARCHAR) AS error_kind FROM {EVENTS_8} GROUP BY raster_id"
)
def header_fields(spark, sf_dir):
    """Headers of real blobs, read by expressions, their checksums verified."""
    found = blobs.encode(rasters.events(spark, sf_dir, 8), "f64").select(F.col("blob_id").alias("raster_id"), headers.header(F.col("content"), verify=True).alias("h"))
    names = ("family", "version", "data_type", "width", "height", "depth", "valid_pixel_count", "remaining_band_count", "max_z_error", "z_min", "z_max", "mask_encoding", "no_data_value", "error_kind")
    return found.select("raster_id", *[f"h.{n}" for n in names])


@query(
    f"SELECT raster_id, min(price) AS low_0, min(customer)::DOUBLE AS low_1, max(price) AS high_0, max(customer)::DOUBLE AS high_1, least(min(price), min(customer)) AS z_min, greatest(max(price), max(customer)) AS z_max FROM {_PRICES} GROUP BY raster_id"
)
def header_ranges(spark, sf_dir):
    """Ranges of each dimension from the bytes behind a header's mask."""
    found = blobs.encode(rasters.order_prices(spark, sf_dir, 8), "f64").select(F.col("blob_id").alias("raster_id"), headers.header(F.col("content")).alias("h"))
    ends = [F.col(f"h.{n}_values")[k].alias(f"{side}_{k}") for side, n in (("low", "min"), ("high", "max")) for k in (0, 1)]
    return found.select("raster_id", *ends, "h.z_min", "h.z_max")


_HIGH = f"SELECT raster_id FROM {EVENTS_8} WHERE valid GROUP BY raster_id HAVING max(value) > 300"


@query(f"SELECT raster_id, y, x, value FROM {EVENTS_8} WHERE valid AND raster_id IN ({_HIGH})")
def header_filter(spark, sf_dir):
    """Only blobs whose header tells of a value over 300 are decoded."""
    made = blobs.encode(rasters.events(spark, sf_dir, 8), "f64").where(headers.header(F.col("content"))["z_max"] > 300)
    return blobs.pixels(made).where("valid").select(F.col("blob_id").alias("raster_id"), "y", "x", "value")


@query(f"SELECT raster_id, {BLOCKS}, dim, count(*) AS n, min(value) AS low, max(value) AS high FROM {EVENTS} WHERE valid GROUP BY ALL")
def tile_stats(spark, sf_dir):
    return tiles.tile_stats(rasters.events(spark, sf_dir))


def _levels_sql(rows: str, error: float = 0.5, micro: int = 8) -> str:
    inner = f"SELECT *, y // {micro} AS by, x // {micro} AS bx, min(value) OVER (PARTITION BY raster_id, y // {micro}, x // {micro}, dim) AS low FROM {rows} WHERE valid"
    return f"SELECT *, CAST(floor((value - low) * CAST({1 / (2 * error)!r} AS DOUBLE) + 0.5) AS BIGINT) AS level FROM ({inner})"


@query(f"SELECT raster_id, y, x, dim, low, level FROM ({_levels_sql(EVENTS)})")
def quantize_tiles(spark, sf_dir):
    return tiles.quantised(rasters.events(spark, sf_dir), 0.5).select("raster_id", "y", "x", "dim", "low", "level")


@query(f"SELECT raster_id, y, x, dim, CASE WHEN level < ceil((high - low) / 1.0) THEN low + level * 1.0 ELSE high END AS value FROM (SELECT *, max(value) OVER (PARTITION BY raster_id) AS high FROM ({_levels_sql(EVENTS)}))")
def dequantize_tiles(spark, sf_dir):
    from pyspark.sql import Window

    rows = tiles.quantised(rasters.events(spark, sf_dir), 0.5).withColumn("high", F.max("value").over(Window.partitionBy("raster_id")))
    return rows.select("raster_id", "y", "x", "dim", tiles.dequantised(F.col("level"), F.col("low"), 1.0, F.col("high")).alias("value"))


def _plan_sql(rows: str, kind: str, error: float = 0.5, micro: int = 8) -> str:
    width = dtype(kind).itemsize

    def fits(name: str) -> str:
        if name == "f32":
            return "CAST(CAST(low AS FLOAT) AS DOUBLE) = low"
        least, most = type_range(name)
        return f"low = floor(low) AND low BETWEEN {least:.0f} AND {most:.0f}"

    cases = "".join(f" WHEN {fits(name)} THEN {dtype(name).itemsize}" for name, _ in NARROWER[kind])
    offset = f"CASE{cases} ELSE {width} END" if cases else f"{width}"
    bits = lambda c: f"CASE WHEN {c} = 0 THEN 0 ELSE length(bin({c})) END"
    real = lambda x: f"CAST({x!r} AS DOUBLE)"
    return f"""
WITH q AS ({_levels_sql(rows, error, micro)}),
b AS (SELECT raster_id, "by", bx, dim, count(*) AS n, min(value) AS low, max(value) AS high, max(level) AS top, count(DISTINCT level) - 1 AS others,
             max(abs(low + level * {real(2 * error)} - value)) AS worst FROM q GROUP BY raster_id, "by", bx, dim),
s AS (SELECT *, {offset} AS o, 1 + n * {width} AS raw, CASE WHEN n <= 255 THEN 1 WHEN n <= 65535 THEN 2 ELSE 4 END AS c,
             CAST({bits('top')} AS BIGINT) AS tb, CAST({bits('others')} AS BIGINT) AS ob FROM b),
t AS (SELECT *, 2 + o + c + (n * tb + 7) // 8 AS simple, 3 + o + c + (others * tb + 7) // 8 + (n * ob + 7) // 8 AS tab FROM s),
u AS (SELECT *, others BETWEEN 1 AND 254 AND tab < simple AS use_tab FROM t),
v AS (SELECT *, CASE WHEN use_tab THEN tab ELSE simple END AS stuffed, (high - low) * {real(1 / (2 * error))} AS levels FROM u),
f AS (SELECT *, CASE WHEN low = 0 AND high = 0 THEN 2 WHEN levels > {2 ** (15 if width < 4 else 30) - 1} THEN 0
                     WHEN floor(levels + 0.5) = 0 THEN CASE WHEN high - low > {real(error)} OR raw <= 1 + o THEN 0 ELSE 3 END
                     WHEN worst > {real(error + error * 1e-12 + 1e-12)} OR raw <= stuffed THEN 0 ELSE 1 END AS form FROM v)
SELECT raster_id, "by", bx, dim, n, CAST(form AS INT) AS form, CAST(CASE form WHEN 2 THEN 1 WHEN 0 THEN raw WHEN 3 THEN 1 + o ELSE stuffed END AS BIGINT) AS bytes, form = 1 AND use_tab AS tabled FROM f"""


@query(_plan_sql(EVENTS, "f64"))
def tile_plan_f64(spark, sf_dir):
    return tiles.tile_plan(rasters.events(spark, sf_dir), 0.5, "f64")


@query(_plan_sql(ORDERS, "i32"))
def tile_plan_i32(spark, sf_dir):
    return tiles.tile_plan(rasters.order_customers(spark, sf_dir), 0.5, "i32")


def _plan_query(kind: str, error: float, sql: str, value: Callable[[], object]) -> None:
    """A plan of each further type: orders, in rasters of 150 columns, with a value made of the customer."""

    def run(spark, sf_dir):
        return tiles.tile_plan(rasters.from_key(rasters.table(spark, sf_dir, "orders"), "o_orderkey", 150, [value()]), error, kind)

    rows = f"({_KEYED.format(key='o_orderkey', width=150)}, CAST(0 AS INT) AS dim, CAST({sql} AS DOUBLE) AS value, true AS valid FROM orders)"
    run.__name__ = f"tile_plan_{kind}"
    query(_plan_sql(rows, kind, error))(run)


_plan_query("u8", 0.5, "o_custkey % 23", lambda: F.col("o_custkey") % 23)
_plan_query("i8", 3.0, "o_custkey % 200 - 100", lambda: F.col("o_custkey") % 200 - 100)
_plan_query("i16", 2.0, "o_custkey % 3000 - 1500", lambda: F.col("o_custkey") % 3000 - 1500)
_plan_query("u16", 0.5, "(o_custkey % 40) * 1600", lambda: F.col("o_custkey") % 40 * 1600)
_plan_query("u32", 7.0, "o_custkey * 1000", lambda: F.col("o_custkey") * 1000)
_plan_query("f32", 0.125, "CAST(o_totalprice AS FLOAT)", lambda: F.col("o_totalprice").cast("float"))

#: Rasters of 20 columns and 32 rows that take each body in turn: many values, few values, one value, and wide ones.
_BODY_VALUE = "CASE o_orderkey // 640 % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey % 640 // 320 WHEN 2 THEN 7 ELSE (o_custkey * 7919 % 65536) * 30000 END"
_BODIES = f"(SELECT o_orderkey // 640 AS raster_id, CAST(o_orderkey % 640 // 20 AS INT) AS y, CAST(o_orderkey % 20 AS INT) AS x, CAST(0 AS INT) AS dim, CAST({_BODY_VALUE} AS DOUBLE) AS value, true AS valid FROM orders)"


def _bodies(spark, sf_dir) -> DataFrame:
    return rasters.from_key(rasters.table(spark, sf_dir, "orders"), "o_orderkey", 20, [F.expr(_BODY_VALUE.replace("//", "DIV"))], strip=32)


@query(
    f"WITH a AS (SELECT raster_id, sum(bytes) AS small, count(*) AS small_n FROM ({_plan_sql(_BODIES, 'i32')}) GROUP BY raster_id), c AS (SELECT raster_id, sum(bytes) AS large, count(*) AS large_n FROM ({_plan_sql(_BODIES, 'i32', micro=16)}) GROUP BY raster_id), "
    f"p AS (SELECT raster_id, max(y) + 1 AS h, max(x) + 1 AS w, count(*) AS valid, min(value) = max(value) AS constant FROM {_BODIES} GROUP BY raster_id), "
    "s AS (SELECT *, small + ((h + 7) // 8) * ((w + 7) // 8) - small_n AS s8, large + ((h + 15) // 16) * ((w + 15) // 16) - large_n AS s16, 4 * valid AS sweep FROM p JOIN a USING (raster_id) JOIN c USING (raster_id)), "
    "t AS (SELECT *, 8 * s8 < 1.5 * h * w AND s8 < 4 * sweep AND greatest(h, w) > 8 AND s16 <= s8 AS larger FROM s), u AS (SELECT *, CASE WHEN larger THEN s16 ELSE s8 END AS tiled FROM t) "
    "SELECT raster_id, CASE WHEN constant THEN 'constant' WHEN sweep <= tiled THEN 'sweep' ELSE 'tiles' END AS body, CAST(CASE WHEN NOT constant AND larger THEN 16 ELSE 8 END AS INT) AS micro, "
    "CAST(CASE WHEN constant THEN 0 ELSE 1 + least(sweep, tiled) END AS BIGINT) AS bytes FROM u"
)
def plan_choice(spark, sf_dir):
    return tiles.body_choice(_bodies(spark, sf_dir), 0.5, "i32")


@query(f"SELECT raster_id, y, x, value FROM {_BODIES}")
def plan_choice_decoded(spark, sf_dir):
    """What comes back from each kind of body; the orders alone, without padding."""
    found = _round_trip(_bodies(spark, sf_dir), "i32", writing.Options(0.5)).select("raster_id", "y", "x", "value")
    return found.join(_bodies(spark, sf_dir).select("raster_id", "y", "x"), ["raster_id", "y", "x"], "left_semi")


@query(f"SELECT raster_id, \"by\", bx, dim, CAST(coalesce(sum(bytes) OVER (PARTITION BY raster_id ORDER BY \"by\", bx, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM ({_plan_sql(ORDERS, 'i32')})")
def tile_offsets(spark, sf_dir):
    plan = tiles.tile_plan(rasters.order_customers(spark, sf_dir), 0.5, "i32")
    return tiles.tile_offsets(plan).select("raster_id", "by", "bx", "dim", "at")


@query(f"SELECT raster_id, CAST(66 + 4 + 2 * 4 + 1 + sum(bytes) AS BIGINT) AS bytes FROM ({_plan_sql(ORDERS, 'i32')}) GROUP BY raster_id")
def blob_size_exact(spark, sf_dir):
    """Real blobs against the size that the plan's expressions predict (all pixels valid, tiles of 8)."""
    full = rasters.order_customers(spark, sf_dir)
    return blobs.encode(full, "i32", writing.Options(0.5)).select(F.col("blob_id").alias("raster_id"), F.length("content").cast("long").alias("bytes"))


#: Each blob's size, as its plan gives it, and the sizes of those before it in its file of 8 blobs.
_SMALL = "(SELECT o_orderkey // 160 AS raster_id, CAST(o_orderkey % 160 // 10 AS INT) AS y, CAST(o_orderkey % 10 AS INT) AS x, CAST(0 AS INT) AS dim, CAST(o_custkey AS DOUBLE) AS value, true AS valid FROM orders)"
_FILED = f"SELECT raster_id // 8 AS file, CAST(raster_id % 8 AS INT) AS band, CAST(79 + sum(bytes) AS BIGINT) AS length FROM ({_plan_sql(_SMALL, 'i32')}) GROUP BY raster_id"


def _blob_files(spark, sf_dir) -> str:
    """The folder of files of 8 blobs each, of orders in rasters of 10 columns and 16 rows."""
    small = rasters.from_key(rasters.table(spark, sf_dir, "orders"), "o_orderkey", 10, [F.col("o_custkey")], strip=16)
    made = blobs.encode(small, "i32", writing.Options(0.5))
    eight = F.array_sort(F.collect_list(F.struct("blob_id", "content")))
    joined = F.aggregate(eight, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b["content"]))
    path = shared.mounted(shared.new_path(spark, "blob-files"))
    spark.dataSource.register(RasterSource)
    made.groupBy(F.floor(F.col("blob_id") / 8).alias("file")).agg(joined.alias("content")).withColumnRenamed("file", "blob_id").write.format("rasterloom").mode("append").save(path)
    return path


@query(f"SELECT file, band, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, length FROM ({_FILED})")
def blob_index(spark, sf_dir):
    """Files of blobs, written and hopped over by their headers: where each blob lies."""
    path = _blob_files(spark, sf_dir)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(path).select("path")
    return ranges.index(files).select(F.regexp_extract("path", r"(\d+)\.blob$", 1).cast("long").alias("file"), "band", "at", "length")


@query(f"SELECT raster_id, CAST(v AS DOUBLE) AS value, n FROM (SELECT raster_id, value AS v, count(*) AS n FROM {_SMALL} GROUP BY raster_id, value)")
def read_ranges(spark, sf_dir):
    """How often each raster has each value, read from files of many blobs by byte ranges, with the index that tasks made."""
    path = _blob_files(spark, sf_dir)
    saved = shared.new_path(spark, "blob-index")
    ranges.index(spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(path).select("path")).write.parquet(saved)
    found = spark.read.format("rasterloom").option("index", shared.mounted(saved)).option("splitBytes", 65536).load(path)
    raster = F.regexp_extract("path", r"(\d+)\.blob$", 1).cast("long") * 8 + F.col("band")
    return found.select(raster.alias("raster_id"), F.explode("values").alias("value")).groupBy("raster_id", "value").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = f"({_KEYED.format(key='o_orderkey', width=150)}, CAST(d AS INT) AS dim, CAST(CASE d WHEN 0 THEN o_custkey ELSE o_custkey + o_orderkey % 10 END AS DOUBLE) AS value FROM orders, range(2) t(d))"


@query(f"SELECT raster_id, y, x, dim, value - lag(value) OVER (PARTITION BY raster_id, y, x ORDER BY dim) AS difference FROM {_PAIRS}")
def diff_tiles(spark, sf_dir):
    return tiles.depth_differences(rasters.order_pairs(spark, sf_dir)).select("raster_id", "y", "x", "dim", "difference")


@query(f"SELECT raster_id, y, x, dim, value FROM {_PAIRS}")
def decode_diff_tiles(spark, sf_dir):
    return _round_trip(rasters.order_pairs(spark, sf_dir), "i32", writing.Options(0.5))


_GRID = [(e, f) for e, f in writing.GRIDS if e > 0.001]


@query(
    "SELECT raster_id, coalesce(" + ", ".join(f"CASE WHEN max(abs(floor(value * {f} + 0.5) - value * {f})) / {f} <= 0.0005 THEN CAST({e} AS DOUBLE) END" for e, f in _GRID)
    + f", CAST(0.001 AS DOUBLE)) AS max_z_error FROM {EVENTS} WHERE valid GROUP BY raster_id"
)
def grid_raise(spark, sf_dir):
    return tiles.grid_raise(rasters.events(spark, sf_dir), 0.001)


@query(f"SELECT raster_id, CAST(0.005 AS DOUBLE) AS max_z_error FROM {EVENTS} GROUP BY raster_id")
def grid_raise_in_header(spark, sf_dir):
    found = blobs.encode(rasters.events(spark, sf_dir), "f64", writing.Options(0.001))
    return found.select(F.col("blob_id").alias("raster_id"), blobs.inspect(F.col("content"))["max_z_error"].alias("max_z_error"))


@query("SELECT event_id, event_id % 2 = 0 AS whole, CASE WHEN event_id % 2 = 0 THEN greatest(floor(value / 100), 0.5) ELSE value / 100 END AS bound FROM events")
def effective_error(spark, sf_dir):
    """A hundredth of each event's value as an error bound, for whole numbers and others in turn."""
    whole = F.col("event_id") % 2 == 0
    return rasters.table(spark, sf_dir, "events").select("event_id", whole.alias("whole"), tiles.effective_error(F.col("value") / 100, whole).alias("bound"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey = 0 THEN 0 ELSE length(bin(o_custkey)) END AS BIGINT) AS bits FROM orders")
def bits_required(spark, sf_dir):
    return rasters.table(spark, sf_dir, "orders").select("o_orderkey", tiles.bits_required(F.col("o_custkey")).alias("bits"))


@query("SELECT event_id, CAST(trunc(least(greatest(value * 10 - 300, -128), 127)) AS BIGINT) AS i8, CAST(trunc(least(greatest(value * 1000 - 300, 0), 65535)) AS BIGINT) AS u16 FROM events")
def saturating_cast(spark, sf_dir):
    v = F.col("value")
    return rasters.table(spark, sf_dir, "events").select("event_id", tiles.saturated(v * 10 - 300, -128, 127, "long").alias("i8"), tiles.saturated(v * 1000 - 300, 0, 65535, "long").alias("u16"))


@query("SELECT vec_id // 256 AS raster_id, CAST(k AS INT) AS dim, min(CAST(embedding[k + 1] AS DOUBLE)) AS low, max(CAST(embedding[k + 1] AS DOUBLE)) AS high, count(*) AS n FROM embeddings, range(64) t(k) GROUP BY ALL")
def depth_ranges(spark, sf_dir):
    return tiles.depth_ranges(rasters.embeddings(spark, sf_dir, depth=True))


@query("SELECT raster_id, dim, min(v) AS low, max(v) AS high, count(*) AS n FROM (SELECT vec_id // 256 AS raster_id, CAST(k AS INT) AS dim, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(k)) GROUP BY ROLLUP (raster_id, dim)")
def depth_ranges_rollup(spark, sf_dir):
    return tiles.depth_ranges_rollup(rasters.embeddings(spark, sf_dir, depth=True))


#: A no-data table: prices of order-priority 1 are the sentinel in both dimensions, of status F in the second.
_ND = f"({_KEYED.format(key='o_orderkey', width=150)}, CAST(d AS INT) AS dim, CASE WHEN o_custkey % 7 = 0 OR d = 1 AND o_custkey % 5 = 0 THEN -9999.0 ELSE CAST(o_custkey AS DOUBLE) END AS value FROM orders, range(2) t(d))"


def _no_data(spark, sf_dir) -> DataFrame:
    df = rasters.table(spark, sf_dir, "orders")
    gone, some = F.col("o_custkey") % 7 == 0, F.col("o_custkey") % 5 == 0
    value = F.col("o_custkey").cast("double")
    return rasters.from_key(df, "o_orderkey", 150, [F.when(gone, -9999.0).otherwise(value), F.when(gone | some, -9999.0).otherwise(value)])


@query(f"SELECT raster_id, y, x, CASE count(*) FILTER (WHERE value = -9999) WHEN 2 THEN 'all' WHEN 1 THEN 'mixed' ELSE 'none' END AS class FROM {_ND} GROUP BY raster_id, y, x")
def nodata_classify(spark, sf_dir):
    return tiles.no_data_classes(_no_data(spark, sf_dir), -9999.0)


@query(f"SELECT raster_id, y, x, dim, value FROM (SELECT *, min(abs(value + 9999)) OVER (PARTITION BY raster_id, y, x) AS a, max(abs(value + 9999)) OVER (PARTITION BY raster_id, y, x) AS b FROM {_ND}) WHERE b > 0")
def nodata_roundtrip(spark, sf_dir):
    return _round_trip(_no_data(spark, sf_dir), "f64", writing.Options(0.0, 8, -9999.0))


@query(f"SELECT raster_id, y, x, dim, value FROM (SELECT *, min(abs(value + 9999)) OVER (PARTITION BY raster_id, y, x) AS a, max(abs(value + 9999)) OVER (PARTITION BY raster_id, y, x) AS b FROM {_ND}) WHERE b > 0")
def nodata_remapped(spark, sf_dir):
    """With an error bound, the sentinel is stored as another value and put back; whole numbers lie on the levels of 0.25."""
    return _round_trip(_no_data(spark, sf_dir), "f64", writing.Options(0.25, 8, -9999.0))


@query(f"SELECT raster_id, CAST(6 AS INT) AS version, CAST(-1 AS DOUBLE) AS z_min, CAST(-9999 AS DOUBLE) AS no_data_value FROM {_ND} GROUP BY raster_id")
def nodata_header(spark, sf_dir):
    found = blobs.encode(_no_data(spark, sf_dir), "f64", writing.Options(0.25, 8, -9999.0)).withColumn("i", blobs.inspect(F.col("content")))
    return found.select(F.col("blob_id").alias("raster_id"), "i.version", "i.z_min", "i.no_data_value")


@query(f"SELECT raster_id, {BLOCKS}, count(*) FILTER (WHERE valid) AS n_valid FROM {EVENTS} GROUP BY ALL")
def mask_counts(spark, sf_dir):
    return tiles.mask_counts(rasters.events(spark, sf_dir))


_MASK = f"SELECT raster_id, CAST((y * 100 + x) // 8 AS BIGINT) AS byte, CAST(sum(CASE WHEN valid THEN 128 >> ((y * 100 + x) % 8) ELSE 0 END) AS BIGINT) AS bits FROM {EVENTS} GROUP BY ALL"


@query(_MASK)
def mask_bitset(spark, sf_dir):
    return tiles.mask_bytes(rasters.events(spark, sf_dir), 100)


@query(
    f"SELECT raster_id, min(byte) AS begin, count(*) AS length, any_value(bits) AS bits FROM (SELECT *, sum(s) OVER (PARTITION BY raster_id ORDER BY byte) AS island FROM "
    f"(SELECT *, CASE WHEN lag(bits) OVER (PARTITION BY raster_id ORDER BY byte) = bits THEN 0 ELSE 1 END AS s FROM ({_MASK}))) GROUP BY raster_id, island"
)
def mask_runs(spark, sf_dir):
    return tiles.mask_runs(tiles.mask_bytes(rasters.events(spark, sf_dir), 100)).select("raster_id", "begin", "length", "bits")


@query(f"SELECT raster_id, y, x, valid FROM {EVENTS} WHERE valid OR true")
def mask_roundtrip(spark, sf_dir):
    source = rasters.events(spark, sf_dir)
    found = blobs.pixels(blobs.encode(source, "f64")).select(F.col("blob_id").alias("raster_id"), "y", "x", "valid")
    # The last strip is padded to whole rows; padding is no source pixel.
    return found.join(source.select("raster_id", "y", "x"), ["raster_id", "y", "x"], "left_semi")


_TYPES = "(VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) t(band, type)"


@query(f"SELECT raster_id, CAST(band AS INT) AS band, y, x, value FROM {EVENTS}, {_TYPES} WHERE event_type = type")
def bands_decode(spark, sf_dir):
    found = blobs.pixels(blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64")).where("valid")
    return found.select(F.col("blob_id").alias("raster_id"), "band", "y", "x", "value")


@query(f"SELECT raster_id, CAST(band AS INT) AS band, y, x, value FROM {EVENTS}, {_TYPES} WHERE event_type = type")
def bands_decode_by_band(spark, sf_dir):
    """The bands of a set in tasks of their own."""
    found = blobs.pixels_by_band(blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64")).where("valid")
    return found.select(F.col("blob_id").alias("raster_id"), "band", "y", "x", "value")


def _stacked(spark, sf_dir, layout):
    """Valid samples of all bands in one array, put back into place by its shape and masks."""
    found = blobs.decode_stacked(blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64"), "f64", layout)
    h, w, n = (F.element_at("shape", k) for k in ((2, 3, 1) if layout == "bsq" else (1, 2, 3)))
    found = found.select("blob_id", "masks", h.alias("h"), w.alias("w"), n.alias("n"), F.posexplode("samples").alias("at", "value"))
    if layout == "bsq":
        x, y, band = F.col("at") % F.col("w"), F.expr("at div w") % F.col("h"), F.expr("at div (w * h)")
    else:
        x, y, band = F.expr("at div n") % F.col("w"), F.expr("at div (n * w)"), F.col("at") % F.col("n")
    found = found.select("*", x.cast("int").alias("x"), y.cast("int").alias("y"), band.cast("int").alias("band"))
    valid = F.expr("masks is null or substring(masks, (y * w + x) * n + band + 1, 1) = X'01'")
    return found.where(valid).select(F.col("blob_id").alias("raster_id"), "band", "y", "x", "value")


@query(f"SELECT raster_id, CAST(band AS INT) AS band, y, x, value FROM {EVENTS}, {_TYPES} WHERE event_type = type")
def bands_stacked_interleaved(spark, sf_dir):
    return _stacked(spark, sf_dir, "interleaved")


@query(f"SELECT raster_id, CAST(band AS INT) AS band, y, x, value FROM {EVENTS}, {_TYPES} WHERE event_type = type")
def bands_stacked_bsq(spark, sf_dir):
    return _stacked(spark, sf_dir, "bsq")


@query(f"SELECT DISTINCT raster_id, CAST(0 AS BIGINT) AS off FROM {EVENTS}")
def band_set_size(spark, sf_dir):
    """Exact sizes of band sets without their bytes, less those of the sets."""
    rows = rasters.event_bands(spark, sf_dir)
    made = blobs.encode_bands(rows, "f64").select(F.col("blob_id").alias("raster_id"), F.length("content").alias("made"))
    return blobs.encoded_sizes(rows, "f64").join(made, "raster_id").select("raster_id", (F.col("n_bytes") - F.col("made")).alias("off"))


@query(f"SELECT raster_id, CAST(band AS INT) AS band, count(*) FILTER (WHERE event_type = type) AS valid_pixel_count FROM {EVENTS}, {_TYPES} GROUP BY raster_id, band")
def bands_split(spark, sf_dir):
    found = blobs.split_bands(blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64"))
    return found.select(F.col("blob_id").alias("raster_id"), "band", "valid_pixel_count")


@query(f"SELECT raster_id, CAST(5 AS INT) AS bands FROM {EVENTS} GROUP BY raster_id")
def band_count(spark, sf_dir):
    found = blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64")
    return found.select(F.col("blob_id").alias("raster_id"), blobs.band_count(F.col("content"))["count"].alias("bands"))


def _layout_sql(at: str) -> str:
    return f"SELECT raster_id, CAST({at} AS BIGINT) AS at, value FROM {EVENTS}, {_TYPES} WHERE event_type = type"


def _layout(spark, sf_dir, layout: str) -> DataFrame:
    found = blobs.pixels(blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64")).where("valid")
    return tiles.in_layout(found, layout, 100, rasters.STRIP, 5).select(F.col("blob_id").alias("raster_id"), "at", "value")


@query(_layout_sql("(y * 100 + x) * 5 + band"))
def layout_interleaved(spark, sf_dir):
    return _layout(spark, sf_dir, "interleaved")


@query(_layout_sql("band * 25600 + y * 100 + x"))
def layout_bsq(spark, sf_dir):
    return _layout(spark, sf_dir, "bsq")


@query(
    "SELECT user_id AS blob_id, event_id AS band, CASE WHEN own THEN mask ELSE (SELECT NULL) END AS mask, effective FROM (SELECT *, last_value(CASE WHEN own THEN {'m': mask} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING).m AS effective "
    "FROM (SELECT user_id, event_id, event_type NOT IN ('view', 'error') AS own, CASE WHEN event_type IN ('click', 'purchase') THEN CAST(value AS VARCHAR) END AS mask FROM events))"
)
def mask_inherit(spark, sf_dir):
    df = rasters.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "error"), "External").when(F.col("event_type") == "signup", "None").otherwise("Explicit")
    rows = df.select(F.col("user_id").alias("blob_id"), F.col("event_id").alias("band"), F.lit(2).alias("family"), kind.alias("mask_encoding"), F.when(kind == "Explicit", F.col("value").cast("string")).alias("mask"))
    return tiles.inherit_masks(rows).select("blob_id", "band", "mask", "effective")


@query(f"SELECT raster_id, CAST(value AS BIGINT) AS symbol, count(*) AS n FROM {PARTS} GROUP BY ALL")
def histogram_plain(spark, sf_dir):
    return tiles.histogram_plain(rasters.part_sizes(spark, sf_dir))


@query(
    f"SELECT raster_id, symbol, count(*) AS n FROM (SELECT raster_id, ((CAST(value - coalesce(CASE WHEN x > 0 THEN lag(value) OVER s END, CASE WHEN y > 0 THEN lag(value) OVER c END, 0) AS BIGINT) % 256) + 256) % 256 AS symbol "
    f"FROM {PARTS} WINDOW s AS (PARTITION BY raster_id ORDER BY y, x), c AS (PARTITION BY raster_id, x ORDER BY y)) GROUP BY ALL"
)
def histogram_delta(spark, sf_dir):
    return tiles.histogram_delta(rasters.part_sizes(spark, sf_dir))


@query(f"SELECT raster_id, {BLOCKS}, count(DISTINCT value) - 1 AS others FROM {PARTS} GROUP BY ALL")
def lut_distinct(spark, sf_dir):
    rows = tiles.blocks(rasters.part_sizes(spark, sf_dir))
    return rows.groupBy("raster_id", "by", "bx").agg((F.count_distinct("value") - 1).alias("others"))


@query(
    "WITH w AS (SELECT event_id, i, ascii(event_type[2 * i + 1]) * 256 + CASE WHEN 2 * i + 2 <= length(event_type) THEN ascii(event_type[2 * i + 2]) ELSE 0 END AS w, (length(event_type) + 1) // 2 AS n FROM events, range(10) t(i) WHERE i < (length(event_type) + 1) // 2), "
    "s AS (SELECT event_id, CAST(sum(w) % 65535 AS BIGINT) AS a, CAST(sum(w * (n - i)) % 65535 AS BIGINT) AS b FROM w GROUP BY event_id) "
    "SELECT event_id, CASE b WHEN 0 THEN 65535 ELSE b END * 65536 + CASE a WHEN 0 THEN 65535 ELSE a END AS checksum FROM s"
)
def checksum_fletcher32(spark, sf_dir):
    df = rasters.table(spark, sf_dir, "events")
    return df.select("event_id", tiles.checksum(F.col("event_type").cast("binary")).cast("long").alias("checksum"))


@query("SELECT raster_id, y, x, CAST(value AS INT) AS value FROM " + ORDERS)
def decode_native_i32(spark, sf_dir):
    """Samples in the blobs' own type, put back into place by their shape."""
    found = blobs.decode_native(blobs.encode(rasters.order_customers(spark, sf_dir), "i32"), "i32")
    rows = found.select("blob_id", "shape", F.posexplode("samples").alias("at", "value"))
    width = F.col("shape")[1]
    rows = rows.select(F.col("blob_id").alias("raster_id"), F.floor(F.col("at") / width).cast("int").alias("y"), (F.col("at") % width).alias("x"), "value")
    return rows.join(rasters.order_customers(spark, sf_dir).select("raster_id", "y", "x"), ["raster_id", "y", "x"], "left_semi")


@query(f"SELECT raster_id, count(*) FILTER (WHERE valid) AS n_valid FROM {EVENTS} GROUP BY raster_id")
def mask_only(spark, sf_dir):
    """Valid pixels by the masks alone; no sample is decoded."""
    found = blobs.encode(rasters.events(spark, sf_dir), "f64").withColumn("mask", blobs.mask_bytes("content"))
    ones = F.length(F.regexp_replace(F.hex("mask"), "00", "")) / 2
    return found.select(F.col("blob_id").alias("raster_id"), ones.cast("long").alias("n_valid"))


@query(f"SELECT raster_id, CAST(band AS INT) AS frame FROM (SELECT DISTINCT raster_id FROM {EVENTS}), {_TYPES}")
def stream_frames(spark, sf_dir):
    """The blobs of each raster's byte stream, framed by their headers alone."""
    found = blobs.frame_lengths(blobs.encode_bands(rasters.event_bands(spark, sf_dir), "f64"))
    return found.where("n_bytes > 0").select(F.col("blob_id").alias("raster_id"), "frame")
@query(
    "WITH w AS (SELECT event_id, i, ascii(props[2 * i + 1]) * 256 + CASE WHEN 2 * i + 2 <= length(props) THEN ascii(props[2 * i + 2]) ELSE 0 END AS w, (length(props) + 1) // 2 AS n FROM events, range(10) t(i) WHERE i < (length(props) + 1) // 2), "
    "s AS (SELECT event_id, CAST(sum(w) % 65535 AS BIGINT) AS a, CAST(sum(w * (n - i)) % 65535 AS BIGINT) AS b FROM w GROUP BY event_id) "
    "SELECT event_id, CASE b WHEN 0 THEN 65535 ELSE b END * 65536 + CASE a WHEN 0 THEN 65535 ELSE a END AS checksum FROM s"
)
def checksum_fletcher32_all(spark, sf_dir):
    """Of texts of several lengths, odd ones too."""
    df = rasters.table(spark, sf_dir, "events")
    return df.select("event_id", tiles.checksum(F.col("props").cast("binary")).cast("long").alias("checksum"))


@query(f"SELECT raster_id, y, x, value FROM {EVENTS} WHERE valid")
def external_mask_join(spark, sf_dir):
    """Blobs whose masks are kept in a table of their own, met by an equi-join."""
    source = rasters.events(spark, sf_dir)
    found = blobs.encode(source, "f64")

    def external(frames):
        import pandas as pd

        from rasterloom.codec import bands

        for frame in frames:
            rows = []
            for blob_id, content in frame.itertuples(index=False):
                b = bands.decode(content)
                p = writing.prepare(b.values, "f64", b.mask, writing.Options(), "External")
                own = None if b.mask is None else b.mask.astype(np.uint8).tobytes()
                rows.append((blob_id, writing.blob(p), own))
            yield pd.DataFrame(rows, columns=["blob_id", "content", "mask"])

    stored = found.mapInPandas(external, "blob_id long, content binary, mask binary")
    joined = stored.select("blob_id", "content").join(stored.select("blob_id", "mask"), "blob_id", "left")
    return blobs.pixels(joined).where("valid").select(F.col("blob_id").alias("raster_id"), "y", "x", "value")


def _damaged(good: bytes) -> list[tuple[str, bytes]]:
    """A sound blob and ways to break it."""

    def patched(at: int, data: bytes, resum: bool = True) -> bytes:
        from rasterloom.codec import bits

        out = bytearray(good)
        out[at : at + len(data)] = data
        if resum:
            out[10:14] = bits.fletcher32(out[14:]).to_bytes(4, "little")
        return bytes(out)

    return [
        ("sound", good), ("magic", b"X" + good[1:]), ("empty", b""), ("version 9", patched(6, b"\x09\0\0\0")), ("no height", patched(14, bytes(4))),
        ("micro-block 33", patched(30, b"\x21\0\0\0")), ("no depth", patched(22, bytes(4))), ("checksum", patched(10, bytes(4), False)), ("cut", good[:-1]),
        ("type 9", patched(38, b"\x09\0\0\0")), ("more behind", good + b"junk"), ("too many valid", patched(26, b"\xff\xff\0\0")),
    ]


_DAMAGE = {
    "sound": None, "magic": "InvalidMagic", "empty": "InvalidMagic", "version 9": "UnsupportedVersion", "no height": "InvalidHeader", "micro-block 33": "InvalidHeader", "no depth": "InvalidHeader",
    "checksum": "ChecksumMismatch", "cut": "Truncated", "type 9": "InvalidBlob", "more behind": "InvalidBlob", "too many valid": "InvalidBlob",
}
_DAMAGED_ROWS = ", ".join(f"('{n}', {'NULL' if k is None else repr(k)})" for n, k in _DAMAGE.items())


@query(f"SELECT raster_id, name, error_kind FROM (SELECT DISTINCT raster_id FROM {_SMALL}), (VALUES {_DAMAGED_ROWS}) d(name, error_kind)")
def validate_malformed(spark, sf_dir):
    """The kind of error of each raster's blob, damaged in each way."""
    small = rasters.from_key(rasters.table(spark, sf_dir, "orders"), "o_orderkey", 10, [F.col("o_custkey")], strip=16)

    def damage(batches):
        import pyarrow as pa

        for batch in batches:
            for blob_id, content in zip(*[c.to_pylist() for c in batch.columns]):
                names, parts = zip(*_damaged(content))
                yield pa.RecordBatch.from_arrays([pa.array([blob_id] * len(names), pa.int64()), pa.array(names), pa.array(parts, pa.binary())], names=["raster_id", "name", "content"])

    rows = blobs.encode(small, "u16").select("blob_id", "content").mapInArrow(damage, "raster_id long, name string, content binary")
    return rows.select("raster_id", "name", blobs.inspect(F.col("content"), strict=True)["error_kind"].alias("error_kind"))


@query(f"SELECT raster_id, CASE raster_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'InvalidMagic' WHEN 2 THEN 'UnsupportedVersion' WHEN 3 THEN 'ChecksumMismatch' WHEN 4 THEN 'Truncated' ELSE 'InvalidHeader' END AS error_kind FROM {_BODIES} GROUP BY raster_id")
def inspect_damaged(spark, sf_dir):
    """A kind of damage for each raster's blob in turn, by binary functions; damage is a row, not the end of a task."""
    content, digits = F.col("content"), F.hex("content")
    put = lambda at, new: F.unhex(F.concat(F.substring(digits, 1, 2 * at), F.lit(new), F.substring(digits, 2 * at + len(new) + 1, 1 << 30)))
    kind = F.col("blob_id") % 6
    damaged = (
        F.when(kind == 1, put(0, "58")).when(kind == 2, put(6, "63000000")).when(kind == 3, put(10, "00000000"))
        .when(kind == 4, F.substring(content, F.lit(1), F.length(content) - 1)).when(kind == 5, put(14, "00000000")).otherwise(content)
    )
    found = blobs.encode(_bodies(spark, sf_dir), "i32", writing.Options(0.5)).select(F.col("blob_id").alias("raster_id"), damaged.alias("content"))
    return found.select("raster_id", blobs.inspect(F.col("content"))["error_kind"].alias("error_kind"))


@query(f"SELECT raster_id, 'i32' AS data_type, CAST(10 AS BIGINT) AS width, max(y) + CAST(1 AS BIGINT) AS height, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM {_SMALL} WHERE raster_id % 3 <> 1 GROUP BY raster_id")
def encode_errors_permissive(spark, sf_dir):
    """Every third blob has lost its last byte; permissive reading leaves it out and goes on."""
    small = rasters.from_key(rasters.table(spark, sf_dir, "orders"), "o_orderkey", 10, [F.col("o_custkey")], strip=16)
    cut = F.when(F.col("blob_id") % 3 == 1, F.substring("content", F.lit(1), F.length("content") - 1)).otherwise(F.col("content"))
    found = blobs.decode(blobs.encode(small, "i32").select("blob_id", cut.alias("content"))).where("error_kind is null")
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b).cast("long")
    return found.select(F.col("blob_id").alias("raster_id"), "data_type", "width", "height", F.size("values").cast("long").alias("n"), total.alias("total"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_lossless_f64(spark, sf_dir)




from rasterloom.plans import bytes_made, choices, sets_checked  # noqa: E402, F401  registers further queries
