"""Queries over how rasters would be written: tiles of differences, Huffman codes, and all bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.codec import writing
from rasterloom.codec.bits import NARROWER
from rasterloom.codec.model import dtype, type_range
from rasterloom.functions import blobs, headers
from rasterloom.operators import planning, tiles
from rasterloom.plans.queries import query
from rasterloom.sources import rasters

_BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


def _offset_sql(kind: str) -> str:
    cases = "".join(f" WHEN low = floor(low) AND low BETWEEN {type_range(n)[0]:.0f} AND {type_range(n)[1]:.0f} THEN {dtype(n).itemsize}" for n, _ in NARROWER[kind])
    return f"CASE{cases} ELSE {dtype(kind).itemsize} END" if cases else f"{dtype(kind).itemsize}"


def tiles_sql(rows: str, kind: str, micro: int = 8) -> str:
    """The plan of whole numbers at an error of 0.5, of values and of differences between dimensions."""
    width = dtype(kind).itemsize
    return f"""
SELECT raster_id, "by", bx, dim, any_value(n) AS n, CAST(arg_min(form, (bytes, diff)) AS INT) AS form, CAST(min(bytes) AS BIGINT) AS bytes, arg_min(tabled, (bytes, diff)) AS tabled, arg_min(diff, (bytes, diff)) AS diff FROM (
  SELECT *, form = 1 AND use_tab AS tabled FROM (
    SELECT *, CASE WHEN low = 0 AND high = 0 THEN 2 WHEN NOT diff AND (stuffed IS NULL OR raw <= stuffed) THEN 0 WHEN stuffed IS NULL THEN -1 WHEN top = 0 THEN 3 ELSE 1 END AS form,
           CASE WHEN low = 0 AND high = 0 THEN 1 WHEN NOT diff AND (stuffed IS NULL OR raw <= stuffed) THEN raw ELSE stuffed END AS bytes FROM (
      SELECT *, CASE WHEN high - low > most THEN NULL WHEN top = 0 THEN 1 + o WHEN use_tab THEN tab ELSE simple END AS stuffed FROM (
        SELECT *, others BETWEEN 1 AND 254 AND tab < simple AS use_tab FROM (
          SELECT *, 2 + o + c + (n * tb + 7) // 8 AS simple, 3 + o + c + (others * tb + 7) // 8 + (n * ob + 7) // 8 AS tab FROM (
            SELECT *, CASE WHEN diff THEN {_offset_sql('i32')} ELSE {_offset_sql(kind)} END AS o, CASE WHEN diff THEN {2**30 - 1} ELSE {2 ** (15 if width < 4 else 30) - 1} END AS most, 1 + n * {width} AS raw,
                   CASE WHEN n <= 255 THEN 1 WHEN n <= 65535 THEN 2 ELSE 4 END AS c, CAST({_BITS.format('top')} AS BIGINT) AS tb, CAST({_BITS.format('others')} AS BIGINT) AS ob FROM (
              SELECT raster_id, y // {micro} AS "by", x // {micro} AS bx, dim, diff, count(*) AS n, min(v) AS low, max(v) AS high, CAST(max(v) - min(v) AS BIGINT) AS top, count(DISTINCT v) - 1 AS others FROM (
                SELECT raster_id, y, x, dim, diff, CASE WHEN diff THEN value - before ELSE value END AS v FROM
                (SELECT *, lag(value) OVER (PARTITION BY raster_id, y, x ORDER BY dim) AS before FROM {rows}), (VALUES (false), (true)) d(diff) WHERE NOT diff OR before IS NOT NULL
              ) GROUP BY ALL)))))))
WHERE form >= 0 GROUP BY ALL"""


_PAIRS_8 = "(SELECT o_orderkey // 150 // 8 AS raster_id, CAST((o_orderkey // 150) % 8 AS INT) AS y, CAST(o_orderkey % 150 AS INT) AS x, CAST(d AS INT) AS dim, CAST(CASE d WHEN 0 THEN o_custkey ELSE o_custkey + o_orderkey % 10 END AS DOUBLE) AS value FROM orders, range(2) t(d))"


@query(tiles_sql(_PAIRS_8, "i32"))
def tile_plan_diff(spark, sf_dir):
    """Values or differences, tile by tile."""
    return planning.tile_plan(rasters.order_pairs(spark, sf_dir, 8), 0.5, "i32")


@query(f"SELECT raster_id, CASE WHEN bool_or(diff) THEN 5 ELSE 4 END AS version, CAST(66 + 4 + 16 + 1 + sum(bytes) AS BIGINT) AS blob_size FROM ({tiles_sql(_PAIRS_8, 'i32')}) GROUP BY raster_id")
def tile_plan_diff_blobs(spark, sf_dir):
    """Version and size of real blobs, which the plan foretells (all valid, two dimensions of i32)."""
    made = blobs.encode(rasters.order_pairs(spark, sf_dir, 8), "i32", writing.Options(0.5))
    return made.select(F.col("blob_id").alias("raster_id"), headers.header(F.col("content")).alias("h")).select("raster_id", "h.version", "h.blob_size")


#: Rows and columns of 8-bit rasters of parts; of orders, whose values take each body in turn, in two dimensions.
_PART_RASTERS = "(SELECT p_partkey // 160 AS raster_id, CAST(p_partkey % 160 // 20 AS INT) AS y, CAST(p_partkey % 20 AS INT) AS x, CAST(0 AS INT) AS dim, CAST(p_size AS DOUBLE) AS value, true AS valid FROM part)"


def _part_rasters(spark, sf_dir) -> DataFrame:
    return rasters.from_key(rasters.table(spark, sf_dir, "part"), "p_partkey", 20, [F.col("p_size")], strip=8)


def histogram_sql(rows: str) -> str:
    """Counts of plain symbols (mode 2) and of differences (mode 1), of rasters whose pixels are all valid."""
    guess = "coalesce(lag(value) OVER (PARTITION BY raster_id, dim, y ORDER BY x), lag(value) OVER (PARTITION BY raster_id, dim, x ORDER BY y), 0)"
    return (
        f"SELECT raster_id, 2 AS mode, CAST(value AS INT) AS s, count(*) AS n FROM {rows} GROUP BY ALL UNION ALL "
        f"SELECT raster_id, 1, s, count(*) FROM (SELECT raster_id, CAST((CAST(value - {guess} AS BIGINT) + 256) % 256 AS INT) AS s FROM {rows}) GROUP BY ALL"
    )


def codes_sql(rows: str) -> str:
    """raster_id, mode and leaves (s, n, l) of both codings."""
    joined = (
        "{'n': t[1].n + t[2].n, 'least': least(t[1].least, t[2].least), 'leaves': list_transform(list_concat(t[1].leaves, t[2].leaves), lambda x: {'s': x.s, 'n': x.n, 'l': x.l + 1})}"
    )
    return (
        f"WITH RECURSIVE h AS ({histogram_sql(rows)}), r AS (SELECT raster_id, mode, list_sort(list({{'n': n, 'least': s, 'leaves': [{{'s': s, 'n': n, 'l': 0}}]}})) AS t FROM h GROUP BY raster_id, mode "
        f"UNION ALL SELECT raster_id, mode, list_sort(list_append(t[3:], {joined})) FROM r WHERE len(t) > 1) "
        "SELECT raster_id, mode, list_transform(t[1].leaves, lambda x: {'s': x.s, 'n': x.n, 'l': greatest(x.l, 1)}) AS leaves FROM r WHERE len(t) = 1"
    )


def sizes_sql(rows: str) -> str:
    return (
        "SELECT raster_id, mode, 16 + 1 + CASE WHEN span <= 255 THEN 1 ELSE 2 END + (span * length(bin(longest)) + 7) // 8 + 4 * ((table_bits + 31) // 32) + 4 * ((body_bits + 31) // 32 + 1) AS bytes FROM "
        "(SELECT raster_id, mode, max(x.s) - min(x.s) + 1 AS span, max(x.l) AS longest, CAST(sum(x.l) AS BIGINT) AS table_bits, CAST(sum(x.n * x.l) AS BIGINT) AS body_bits "
        f"FROM (SELECT raster_id, mode, unnest(leaves) AS x FROM ({codes_sql(rows)})) GROUP BY raster_id, mode)"
    )


@query(f"SELECT raster_id, x.s AS symbol, x.n AS n, CAST(x.l AS INT) AS length FROM (SELECT raster_id, unnest(leaves) AS x FROM ({codes_sql(_PART_RASTERS)}) WHERE mode = 2)")
def huffman_lengths(spark, sf_dir):
    """The bits of each symbol's code, by a fold over the histogram."""
    counts = tiles.histogram_plain(_part_rasters(spark, sf_dir)).groupBy("raster_id").agg(F.collect_list(F.struct("symbol", "n")).alias("counts"))
    return counts.select("raster_id", F.inline(planning.code_lengths(F.col("counts"))))


@query(f"SELECT raster_id, CAST(arg_min(mode, (bytes, -mode)) AS INT) AS mode, CAST(min(bytes) AS BIGINT) AS bytes FROM ({sizes_sql(_PART_RASTERS)}) GROUP BY raster_id")
def huffman_choice(spark, sf_dir):
    """Plain or as differences: the smaller by the exact sizes of table and codes."""
    return planning.huffman_plan(_part_rasters(spark, sf_dir), "u8").select("raster_id", "mode", "bytes")


_SIDE = "o_orderkey % 240"
_U8 = (
    f"CASE o_orderkey // 240 % 6 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN o_custkey * 7919 % 251 WHEN 3 THEN CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 2 * 200 ELSE o_custkey % 13 * 19 END WHEN 4 THEN {_SIDE} // 96 * 40 + o_custkey % 5 ELSE {_SIDE} // 192 END",
    f"CASE o_orderkey // 240 % 6 WHEN 0 THEN 7 WHEN 1 THEN 9 WHEN 2 THEN o_custkey * 104729 % 241 WHEN 3 THEN CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 2 * 200 ELSE o_custkey % 17 * 11 END WHEN 4 THEN {_SIDE} // 96 * 40 + o_custkey % 5 + o_custkey % 3 ELSE {_SIDE} // 192 * 3 END",
)
_U8_ROWS = f"(SELECT o_orderkey // 240 AS raster_id, CAST({_SIDE} // 12 AS INT) AS y, CAST(o_orderkey % 12 AS INT) AS x, CAST(d AS INT) AS dim, CAST(CASE d WHEN 0 THEN {_U8[0]} ELSE {_U8[1]} END AS DOUBLE) AS value, true AS valid FROM orders, range(2) t(d))"


def _u8(spark, sf_dir) -> DataFrame:
    return rasters.from_key(rasters.table(spark, sf_dir, "orders"), "o_orderkey", 12, [F.expr(v.replace("//", "DIV")) for v in _U8], strip=20)


def bodies_sql(rows: str) -> str:
    """planning.body_plan() of u8 samples at an error of 0.5, of rasters whose pixels are all valid."""
    return f"""
WITH s AS (SELECT raster_id, max(y) + 1 AS h, max(x) + 1 AS w, max(dim) + 1 AS depth, count(*) AS sweep, min(value) = max(value) AS one FROM {rows} GROUP BY raster_id),
d AS (SELECT raster_id, bool_and(same) AS each FROM (SELECT raster_id, dim, min(value) = max(value) AS same FROM {rows} GROUP BY ALL) GROUP BY raster_id),
a AS (SELECT raster_id, sum(bytes) AS small, bool_or(diff) AS small_diff FROM ({tiles_sql(rows, 'u8')}) GROUP BY raster_id),
b AS (SELECT raster_id, sum(bytes) AS large, bool_or(diff) AS large_diff FROM ({tiles_sql(rows, 'u8', 16)}) GROUP BY raster_id),
c AS (SELECT raster_id, min(bytes) AS coded FROM ({sizes_sql(rows)}) GROUP BY raster_id),
j AS (SELECT *, greatest(h, w) > 8 AND 8 * small < 1.5 * h * w * depth AND small < 4 * sweep AND small < 2 * coded AND large <= least(small, coded) AS doubled FROM s JOIN d USING (raster_id) JOIN a USING (raster_id) JOIN b USING (raster_id) JOIN c USING (raster_id)),
t AS (SELECT *, coded < small AND NOT doubled AS coding, CASE WHEN doubled THEN large ELSE small END AS tiled, CASE WHEN doubled THEN large_diff ELSE small_diff END AS changed FROM j),
u AS (SELECT *, 1 + CASE WHEN coding THEN coded ELSE tiled END AS total FROM t),
v AS (SELECT *, CASE WHEN one THEN 'constant' WHEN each THEN 'depths' WHEN sweep <= total THEN 'sweep' WHEN coding THEN 'huffman' ELSE 'tiles' END AS body FROM u)
SELECT raster_id, body, CAST(CASE WHEN doubled AND NOT one AND NOT each THEN 16 ELSE 8 END AS INT) AS micro, CAST(CASE WHEN body = 'tiles' AND changed THEN 5 ELSE 4 END AS INT) AS version,
       CAST(CASE WHEN one OR each THEN 0 ELSE 1 + least(sweep, total) END AS BIGINT) AS bytes FROM v"""


@query(bodies_sql(_U8_ROWS))
def plan_choice_u8(spark, sf_dir):
    """Each of the six bodies, chosen by exact sizes."""
    return planning.body_plan(_u8(spark, sf_dir), 0.5, "u8")


@query(f"SELECT raster_id, micro AS micro_block_size, version, 70 + CASE WHEN body = 'constant' THEN 0 ELSE 4 END + bytes AS blob_size FROM ({bodies_sql(_U8_ROWS)})")
def plan_choice_u8_blobs(spark, sf_dir):
    """Block size, version and size of real blobs, as the choice foretells."""
    made = blobs.encode(_u8(spark, sf_dir), "u8", writing.Options(0.5))
    return made.select(F.col("blob_id").alias("raster_id"), headers.header(F.col("content")).alias("h")).select("raster_id", "h.micro_block_size", "h.version", "h.blob_size")
