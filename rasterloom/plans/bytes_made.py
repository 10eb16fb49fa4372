"""Queries over the bytes of blobs, made and read by expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import coding, tiles
from rasterloom.plans.queries import _KEYED_8, EVENTS_8, ORDERS, query
from rasterloom.sources import rasters

_LEVELS = f"""SELECT *, CASE WHEN max(level) OVER w = 0 THEN 0 ELSE length(bin(max(level) OVER w)) END AS bits FROM (
  SELECT raster_id, y // 8 AS "by", x // 8 AS bx, dim, row_number() OVER (PARTITION BY raster_id, y // 8, x // 8, dim ORDER BY y, x) - 1 AS place,
         CAST(value - min(value) OVER (PARTITION BY raster_id, y // 8, x // 8, dim) AS BIGINT) AS level FROM {ORDERS}) WINDOW w AS (PARTITION BY raster_id, "by", bx, dim)"""
_BYTES = f"""SELECT raster_id, "by", bx, dim, (place * bits + k) // 8 AS octet, sum(((level >> k) & 1) << ((place * bits + k) % 8)) AS v FROM ({_LEVELS}), range(32) t(k) WHERE k < bits GROUP BY ALL"""


@query(f"""SELECT raster_id, "by", bx, dim, string_agg(printf('%02X', CAST(v AS INT)), '' ORDER BY octet) AS packed FROM ({_BYTES}) GROUP BY ALL""")
def packed_blocks(spark, sf_dir):
    """The packed levels of each block with more than one level, in hexadecimal digits."""
    levels = coding.block_levels(rasters.order_customers(spark, sf_dir), 0.5).where("bits > 0")
    return coding.packed(levels, coding.BLOCK).select(*coding.BLOCK, F.hex("packed").alias("packed"))


@query(f"""SELECT raster_id, "by", bx, dim, CAST(place AS INT) AS place, level FROM ({_LEVELS})""")
def unpacked_blocks(spark, sf_dir):
    """The levels again, from the packed bytes."""
    made = coding.packed(coding.block_levels(rasters.order_customers(spark, sf_dir), 0.5), coding.BLOCK)
    return made.select(*coding.BLOCK, F.posexplode(coding.unpacked(F.col("packed"), F.col("n"), F.col("bits"))).alias("place", "level"))


#: A mask with long runs: events whose block of 12 keys, and of 90 keys, is of some kind.
_OK = "event_id // 12 % 3 > 0 AND event_id // 90 % 4 <> 2 OR event_id % 800 // 200 = 1"
_MASKED = f"({_KEYED_8.format(key='event_id', width=100)}, {_OK} AS valid FROM events)"
_MASK = f"SELECT raster_id, CAST((y * 100 + x) // 8 AS BIGINT) AS byte, CAST(sum(CASE WHEN valid THEN 128 >> ((y * 100 + x) % 8) ELSE 0 END) AS BIGINT) AS bits FROM {_MASKED} GROUP BY ALL"
_RUNS = f"""SELECT raster_id, min(byte) AS b, count(*) AS n, any_value(bits) AS v, max(byte) = any_value(top) AS ends FROM (SELECT *, max(byte) OVER (PARTITION BY raster_id) AS top, sum(s) OVER (PARTITION BY raster_id ORDER BY byte) AS island FROM
  (SELECT *, CASE WHEN lag(bits) OVER (PARTITION BY raster_id ORDER BY byte) = bits THEN 0 ELSE 1 END AS s FROM ({_MASK}))) GROUP BY raster_id, island"""


def _segments_sql(strict: bool) -> str:
    """The runs one after the other, each with what became of the one before it."""
    if strict:
        taken = f"SELECT *, n > 5 OR n = 5 AND NOT ends AS taken FROM ({_RUNS})"
    else:
        limit = "CASE (CASE WHEN {before} THEN 1 ELSE 0 END) + (CASE WHEN ends THEN 1 ELSE 0 END) WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 6 END"
        taken = (
            f"WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY b) AS k FROM ({_RUNS})), "
            f"w AS (SELECT *, n >= {limit.format(before='true')} AS taken FROM o WHERE k = 1 UNION ALL "
            f"SELECT o.raster_id, o.b, o.n, o.v, o.ends, o.k, o.n >= {limit.format(before='w.taken').replace('ends', 'o.ends')} FROM w JOIN o ON o.raster_id = w.raster_id AND o.k = w.k + 1) SELECT * FROM w"
        )
    return (
        "SELECT raster_id, min(b) AS begin, CASE WHEN taken THEN 'repeat' ELSE 'literal' END AS kind, CAST(sum(n) AS BIGINT) AS length, CASE WHEN taken THEN any_value(v) END AS value FROM "
        f"(SELECT *, sum(CASE WHEN taken THEN 1 ELSE 0 END) OVER (PARTITION BY raster_id ORDER BY b) AS g FROM ({taken})) GROUP BY raster_id, g, taken"
    )


def _mask(spark, sf_dir):
    df = rasters.table(spark, sf_dir, "events")
    return tiles.mask_bytes(rasters.from_key(df, "event_id", 100, [F.col("value")], F.expr(_OK.replace("//", "DIV")), strip=8), 100)


@query(_segments_sql(False))
def mask_segments(spark, sf_dir):
    return coding.mask_segments(_mask(spark, sf_dir))


@query(_segments_sql(True))
def mask_segments_strict(spark, sf_dir):
    return coding.mask_segments(_mask(spark, sf_dir), strict=True)


_OCTETS = f"SELECT raster_id, string_agg(printf('%02X', CAST(bits AS INT)), '' ORDER BY byte) AS digits FROM ({_MASK}) GROUP BY raster_id"


@query(
    f"SELECT raster_id, string_agg(printf('%02X%02X', CAST(head & 255 AS INT), CAST((head >> 8) & 255 AS INT)) || CASE kind WHEN 'repeat' THEN printf('%02X', CAST(value AS INT)) ELSE substr(digits, 2 * begin + 1, 2 * length) END, '' ORDER BY begin) || '0080' AS coded "
    f"FROM (SELECT *, CASE kind WHEN 'repeat' THEN 65536 - length ELSE length END AS head FROM ({_segments_sql(False)})) JOIN ({_OCTETS}) USING (raster_id) GROUP BY raster_id"
)
def mask_coded(spark, sf_dir):
    """The bytes of each mask's run coding, in hexadecimal digits."""
    return coding.coded_masks(_mask(spark, sf_dir)).select("raster_id", F.hex("coded").alias("coded"))


_PART_VALUES = "SELECT p_partkey // 20 // 256 AS raster_id, CAST(0 AS INT) AS dim, CAST((p_partkey // 20) % 256 AS INT) AS y, CAST(p_partkey % 20 AS INT) AS x, CAST(p_size AS BIGINT) AS value FROM part"


@query(_PART_VALUES)
def delta_restored(spark, sf_dir):
    """Samples from their differences."""
    return coding.delta_restored(tiles.delta_symbols(rasters.part_sizes(spark, sf_dir)))


@query(f"SELECT raster_id, dim, y, x, CAST(floor(value) % 256 AS BIGINT) AS value FROM {EVENTS_8} WHERE valid")
def delta_restored_masked(spark, sf_dir):
    """The same where pixels are missing, so that samples refer to whatever was last."""
    pixels = rasters.events(spark, sf_dir, 8).withColumn("value", F.pmod(F.floor("value"), F.lit(256)).cast("double"))
    return coding.delta_restored(tiles.delta_symbols(pixels))
