"""Encode analysis and planning as DataFrame expressions, without a Python worker.

Inputs are pixel tables (raster_id, y, x, dim, value, valid). Blocks, levels, sizes and
choices are aggregates and CASE expressions, so Catalyst fuses and partially aggregates
them before the one shuffle by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.codec.bits import NARROWER
from rasterloom.codec.model import dtype, type_range
from rasterloom.codec.reading import takes_huffman
from rasterloom.codec.writing import GRIDS, LARGEST_BLOCK

BLOCK = ["raster_id", "by", "bx", "dim"]


def blocks(pixels: DataFrame, micro: int = 8) -> DataFrame:
    """Valid samples with their block."""
    return pixels.where("valid").withColumns({"by": F.floor(F.col("y") / micro).cast("int"), "bx": F.floor(F.col("x") / micro).cast("int")})


def tile_stats(pixels: DataFrame, micro: int = 8) -> DataFrame:
    return blocks(pixels, micro).groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def effective_error(error: Column, integer: Column | bool) -> Column:
    integer = F.lit(integer) if isinstance(integer, bool) else integer
    return F.when(integer, F.greatest(F.floor(error).cast("double"), F.lit(0.5))).otherwise(error)


def bits_required(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n))).cast("long")


def saturated(value: Column, low: float, high: float, kind: str) -> Column:
    """Toward zero, held within the type's range, NaN and null to 0; never a cast error."""
    held = F.least(F.greatest(F.nanvl(value, F.lit(0.0)), F.lit(float(low))), F.lit(float(high)))
    return F.coalesce(held, F.lit(0.0)).cast(kind)


def quantised(pixels: DataFrame, error: float, micro: int = 8) -> DataFrame:
    """Each valid sample's level above its block's least value, and what comes back."""
    low = F.min("value").over(Window.partitionBy(*BLOCK))
    rows = blocks(pixels, micro).withColumn("low", low)
    rows = rows.withColumn("level", F.floor((F.col("value") - F.col("low")) * F.lit(1 / (2 * error)) + 0.5).cast("long"))
    return rows.withColumn("back", F.col("low") + F.col("level") * F.lit(2 * error))


def dequantised(level: Column, offset: Column, step: float, top: Column) -> Column:
    return F.when(level < F.ceil((top - offset) / step), offset + level * F.lit(step)).otherwise(top)


def offset_bytes(low: Column, data_type: str) -> Column:
    """Bytes of the narrowest type that holds a block's offset exactly."""

    def fits(name: str) -> Column:
        if name == "f32":
            return low.cast("float").cast("double") == low
        return (low == F.floor(low)) & low.between(*type_range(name))

    found = F.lit(dtype(data_type).itemsize)
    for name, _ in reversed(NARROWER[data_type]):
        found = F.when(fits(name), dtype(name).itemsize).otherwise(found)
    return found


def tile_plan(pixels: DataFrame, error: float, data_type: str, micro: int = 8, requested: float | None = None) -> DataFrame:
    """Form (2 zero, 3 constant, 1 stuffed, 0 raw), bytes and whether a table is used, for each block with a
    valid sample, of any of the eight types. error: above zero and, for whole numbers, as effective_error()
    gives it; requested (error where not given): what no sample may be off by."""
    requested, width = error if requested is None else requested, dtype(data_type).itemsize
    rows = quantised(pixels, error, micro)
    found = rows.groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.max("level").alias("top"),
        (F.count_distinct("level") - 1).alias("others"),
        F.max(F.abs(F.col("back") - F.col("value"))).alias("worst"),
    )
    n, low, high = F.col("n"), F.col("low"), F.col("high")
    offset, count = offset_bytes(low, data_type), F.when(n <= 255, 1).when(n <= 65535, 2).otherwise(4)
    raw = 1 + n * width
    simple = 1 + offset + 1 + count + F.ceil(n * bits_required(F.col("top")) / 8)
    table = 1 + offset + 1 + count + 1 + F.ceil(F.col("others") * bits_required(F.col("top")) / 8) + F.ceil(n * bits_required(F.col("others")) / 8)
    tabled = F.col("others").between(1, 254) & (table < simple)
    stuffed = F.when(tabled, table).otherwise(simple)
    levels = (high - low) * F.lit(1 / (2 * error))
    bounded = F.col("worst") <= F.lit(requested + requested * 1e-12 + 1e-12)
    form = (
        F.when((low == 0) & (high == 0), 2)
        .when(levels > most_levels(data_type), 0)
        .when(F.floor(levels + 0.5) == 0, F.when(high - low > requested, 0).when(raw <= 1 + offset, 0).otherwise(3))
        .when(~bounded | (raw <= stuffed), 0)
        .otherwise(1)
    )
    found = found.withColumn("form", form.cast("int"))
    size = F.when(F.col("form") == 2, F.lit(1)).when(F.col("form") == 0, raw).when(F.col("form") == 3, 1 + offset).otherwise(stuffed)
    return found.select(*BLOCK, "n", "form", size.cast("long").alias("bytes"), ((F.col("form") == 1) & tabled).alias("tabled"))


def most_levels(data_type: str) -> float:
    return 2.0 ** (15 if dtype(data_type).itemsize < 4 else 30) - 1


def body_choice(pixels: DataFrame, error: float, data_type: str, micro: int = 8) -> DataFrame:
    """(raster_id, body, micro, bytes): what a raster's samples are written as: constant, a sweep of all
    valid samples, or tiles, with the micro-block doubled where that is no larger. Of one dimension, with an
    error above zero, where Huffman coding can't apply. All candidates' sizes are aggregates."""
    if takes_huffman(data_type, error):
        raise ValueError("samples that Huffman coding may apply to")
    shape = pixels.groupBy("raster_id").agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count_if("valid").alias("valid"),
        F.min(F.when(F.col("valid"), F.col("value"))).alias("least"), F.max(F.when(F.col("valid"), F.col("value"))).alias("most"),
    )
    for name, side in (("small", micro), ("large", 2 * micro)):
        sizes = tile_plan(pixels, error, data_type, side).groupBy("raster_id").agg(F.sum("bytes").alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
        blocks_ = F.ceil(F.col("h") / side) * F.ceil(F.col("w") / side)  # one without a valid sample takes a byte
        shape = shape.join(sizes, "raster_id", "left").withColumn(name, F.coalesce(name, F.lit(0)) + blocks_ - F.coalesce(f"{name}_n", F.lit(0)))
    small, large, sweep = F.col("small"), F.col("large"), F.col("valid") * dtype(data_type).itemsize
    larger = (F.lit(2 * micro) <= LARGEST_BLOCK) & (8 * small < 1.5 * F.col("h") * F.col("w")) & (small < 4 * sweep) & (F.greatest("h", "w") > micro) & (large <= small)
    tiled = F.when(larger, large).otherwise(small)
    constant = F.coalesce(F.col("least") == F.col("most"), F.lit(True))
    body = F.when(constant, "constant").when(sweep <= tiled, "sweep").otherwise("tiles")
    size = F.when(constant, 0).otherwise(1 + F.least(sweep, tiled))
    side = F.when(~constant & larger, 2 * micro).otherwise(micro)
    return shape.select("raster_id", body.alias("body"), side.alias("micro"), size.cast("long").alias("bytes"))


def tile_offsets(plan: DataFrame) -> DataFrame:
    """Each tile's place in its raster's body: the bytes of the tiles before it."""
    before = Window.partitionBy("raster_id").orderBy("by", "bx", "dim").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0)))


def depth_ranges(pixels: DataFrame) -> DataFrame:
    return pixels.where("valid").groupBy("raster_id", "dim").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


def depth_ranges_rollup(pixels: DataFrame) -> DataFrame:
    """Ranges of each dimension and of all (dim null), in one pass."""
    return pixels.where("valid").rollup("raster_id", "dim").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


def grid_raise(pixels: DataFrame, error: float) -> DataFrame:
    """The error bound that each raster's decimal grid allows: the worst distance to every grid in one aggregation."""
    open_ = [(e, f) for e, f in GRIDS if e > error]
    worst = [F.max(F.abs(F.floor(F.col("value") * f + 0.5) - F.col("value") * f)).alias(f"g{i}") for i, (_, f) in enumerate(open_)]
    found = pixels.where("valid").groupBy("raster_id").agg(*worst)
    raised = F.coalesce(*[F.when(F.col(f"g{i}") / f <= error / 2, F.lit(e)) for i, (e, f) in enumerate(open_)], F.lit(error))
    return found.select("raster_id", raised.alias("max_z_error"))


def no_data_classes(pixels: DataFrame, sentinel: float) -> DataFrame:
    """For each pixel: whether all, some or none of its dimensions are the sentinel."""
    hits = F.count_if(F.col("value") == sentinel)
    found = pixels.where("valid").groupBy("raster_id", "y", "x").agg(hits.alias("hits"), F.count(F.lit(1)).alias("depth"))
    return found.select("raster_id", "y", "x", F.when(F.col("hits") == F.col("depth"), "all").when(F.col("hits") > 0, "mixed").otherwise("none").alias("class"))


def mask_counts(pixels: DataFrame, micro: int = 8) -> DataFrame:
    """Valid pixels of each block, blocks without any included."""
    place = pixels.where("dim = 0").select("raster_id", F.floor(F.col("y") / micro).cast("int").alias("by"), F.floor(F.col("x") / micro).cast("int").alias("bx"), "valid")
    return place.groupBy("raster_id", "by", "bx").agg(F.count_if("valid").alias("n_valid"))


def mask_bytes(pixels: DataFrame, width: int) -> DataFrame:
    """The mask as bytes, most significant bit first."""
    i = F.col("y") * width + F.col("x")
    bit = F.when(F.col("valid"), F.pow(F.lit(2), 7 - F.pmod(i, F.lit(8))).cast("long")).otherwise(0)
    return pixels.where("dim = 0").groupBy("raster_id", F.floor(i / 8).alias("byte")).agg(F.sum(bit).cast("long").alias("bits"))


def mask_runs(mask: DataFrame) -> DataFrame:
    """Runs of equal mask bytes: where each begins and how long it is."""
    by = Window.partitionBy("raster_id").orderBy("byte")
    starts = (F.lag("bits").over(by).isNull() | (F.lag("bits").over(by) != F.col("bits"))).cast("long")
    island = mask.withColumn("starts", starts).withColumn("island", F.sum("starts").over(by))
    return island.groupBy("raster_id", "island").agg(F.min("byte").alias("begin"), F.count(F.lit(1)).alias("length"), F.first("bits").alias("bits"))


def inherit_masks(bands: DataFrame) -> DataFrame:
    """Adds effective: the mask that each band of (blob_id, band, family, mask_encoding, mask) uses.

    A band that stores no mask but needs one takes over the last one before it; a band without
    a mask, or a change of family, ends what is handed on. The mask is in a struct, so that "no
    mask" is a value that is handed on too.
    """
    order = Window.partitionBy("blob_id").orderBy("band")
    rows = bands.withColumn("turn", F.sum((F.lag("family").over(order) != F.col("family")).cast("int")).over(order))
    rows = rows.withColumn("turn", F.coalesce("turn", F.lit(0)))
    run = Window.partitionBy("blob_id", "turn").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("mask_encoding") != "External", F.struct("mask"))
    return rows.withColumn("effective", F.last(own, ignorenulls=True).over(run)["mask"]).drop("turn")


def histogram_plain(pixels: DataFrame) -> DataFrame:
    return pixels.where("valid").groupBy("raster_id", F.col("value").cast("long").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def delta_symbols(pixels: DataFrame) -> DataFrame:
    """raster_id, dim, y, x and symbol: each valid sample's difference, modulo 256, from the left neighbour, else
    the one above, else the last valid sample."""
    row = Window.partitionBy("raster_id", "dim", "y").orderBy("x")
    column = Window.partitionBy("raster_id", "dim", "x").orderBy("y")
    scan = Window.partitionBy("raster_id", "dim").orderBy("y", "x")
    near = lambda w, at: F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag("value").over(w))
    guess = F.coalesce(near(row, "x"), near(column, "y"), F.lag("value").over(scan), F.lit(0.0))
    return pixels.where("valid").select("raster_id", "dim", "y", "x", F.pmod((F.col("value") - guess).cast("long"), F.lit(256)).alias("symbol"))


def histogram_delta(pixels: DataFrame) -> DataFrame:
    """Counts of delta_symbols()."""
    return delta_symbols(pixels).groupBy("raster_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


def depth_differences(pixels: DataFrame) -> DataFrame:
    """Differences between dimensions of a pixel; null in the first."""
    by = Window.partitionBy("raster_id", "y", "x").orderBy("dim")
    return pixels.where("valid").withColumn("difference", F.col("value") - F.lag("value").over(by))


def in_layout(pixels: DataFrame, layout: str, width: int, height: int, bands: int) -> DataFrame:
    """Each sample's place in one homogeneous vector of all bands: by arithmetic, without a sort."""
    i = F.col("y") * width + F.col("x")
    at = i * bands + F.col("band") if layout == "interleaved" else F.col("band") * (width * height) + i
    return pixels.withColumn("at", at.cast("long"))


def checksum(content: Column) -> Column:
    """Fletcher's sums of a binary of any length, in closed form over its 16-bit words; an odd last byte is the high one of a word."""
    n = F.ceil(F.length(content) / 2).cast("int")
    digits = lambda i: F.rpad(F.hex(F.substring(content, 2 * i + 1, F.lit(2))), 4, "0")
    word = lambda i: F.conv(digits(i), 16, 10).cast("long")
    words = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), word))
    weighed = F.transform(words, lambda w, i: w * (n - i))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    fold = lambda s: F.when(s % 65535 == 0, 65535).otherwise(s % 65535)
    return fold(total(weighed)) * 65536 + fold(total(words))
