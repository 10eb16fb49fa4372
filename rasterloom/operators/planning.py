"""How a whole raster would be written, as DataFrame expressions: tiles of values or of differences between
dimensions, Huffman codes, and the choice among all bodies by their exact sizes.

Pixel tables are as in operators.tiles. Both candidates of a tile are planned in one pass: rows are dealt once
by the block of a pixel, which all later windows and groups refine, so nothing is shuffled between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.codec.huffman import LONGEST_WRITTEN, shift_of
from rasterloom.codec.model import dtype, is_integer
from rasterloom.codec.reading import takes_huffman
from rasterloom.codec.writing import LARGEST_BLOCK
from rasterloom.operators import tiles
from rasterloom.operators.tiles import BLOCK, bits_required, most_levels, offset_bytes

ZERO, RAW, STUFFED, FLAT, NONE = 2, 0, 1, 3, -1


def takes_differences(data_type: str, error: float) -> bool:
    """Whether tiles of differences between dimensions may be written."""
    return is_integer(data_type) and abs(error - 0.5) < 1e-5


def _candidates(pixels: DataFrame, differences: bool, micro: int) -> DataFrame:
    """Valid samples by block, and, as further rows (diff), what each is above the dimension before."""
    rows = tiles.blocks(pixels, micro).select(*BLOCK, "y", "x", "value").repartition("raster_id", "by", "bx")
    if not differences:
        return rows.select(*BLOCK, "value", F.lit(False).alias("diff"))
    before = F.lag("value").over(Window.partitionBy("raster_id", "by", "bx", "y", "x").orderBy("dim"))
    one = lambda d, v: F.struct(F.lit(d).alias("diff"), v.alias("value"))
    own, change = one(False, F.col("value")), one(True, F.col("value") - F.col("before"))
    both = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, change))
    return rows.withColumn("before", before).select(*BLOCK, F.inline(both))


def tile_plan(pixels: DataFrame, error: float, data_type: str, micro: int = 8, requested: float | None = None) -> DataFrame:
    """Form (2 zero, 3 constant, 1 stuffed, 0 raw), bytes, whether a table is used, and whether it is of differences
    (diff), for each block and dimension with a valid sample.

    error: zero for floats without loss, else as effective_error() gives it. Differences are taken where they are
    strictly smaller; they have no raw form, and must fit 32 bits.
    """
    requested, width = error if requested is None else requested, dtype(data_type).itemsize
    keys = [*BLOCK, "diff"]
    rows = _candidates(pixels, takes_differences(data_type, error), micro).withColumn("low", F.min("value").over(Window.partitionBy(*keys)))
    if error > 0:
        rows = rows.withColumn("level", F.floor((F.col("value") - F.col("low")) * F.lit(1 / (2 * error)) + 0.5).cast("long"))
        levels = (F.col("high") - F.col("low")) * F.lit(1 / (2 * error))
    else:
        rows = rows.withColumn("level", F.lit(0).cast("long"))
        levels = F.when(F.col("high") == F.col("low"), F.lit(0.0)).otherwise(F.lit(float("inf")))
    off = F.col("low") + F.col("level") * F.lit(2 * error) - F.col("value") if error > 0 else F.lit(0.0)
    found = rows.withColumn("off", F.abs(off)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("level").alias("top"), F.max("off").alias("worst"),
        F.size(F.collect_set("level")).cast("long").alias("distinct"),
    )
    n, diff, others = F.col("n"), F.col("diff"), F.col("distinct") - 1
    offset = F.when(diff, offset_bytes(F.col("low"), "i32")).otherwise(offset_bytes(F.col("low"), data_type))
    head = 2 + offset + F.when(n <= 255, 1).when(n <= 65535, 2).otherwise(4)
    simple = head + F.ceil(n * bits_required(F.col("top")) / 8)
    table = head + 1 + F.ceil(others * bits_required(F.col("top")) / 8) + F.ceil(n * bits_required(others) / 8)
    tabled = others.between(1, 254) & (table < simple)
    raw = F.when(~diff, 1 + n * width)
    fits = (levels <= F.when(diff, most_levels("i32")).otherwise(most_levels(data_type))) & (~diff | (F.col("low") >= -(2.0**31)) & (F.col("high") < 2.0**31))
    top, bounded = F.floor(levels + 0.5), F.col("worst") <= F.lit(requested + requested * 1e-12 + 1e-12)
    flat = fits & (top == 0) & (F.col("high") - F.col("low") <= requested)
    size = F.when(flat, 1 + offset).when(fits & (top > 0) & bounded, F.when(tabled, table).otherwise(simple))
    zero = (F.col("low") == 0) & (F.col("high") == 0)
    found = found.select(*keys, "n", zero.alias("zero"), flat.alias("flat"), tabled.alias("may_table"), size.cast("long").alias("size"), raw.cast("long").alias("raw"))
    size, raw = F.col("size"), F.col("raw")
    form = F.when(F.col("zero"), ZERO).when(raw.isNotNull() & (size.isNull() | (raw <= size)), RAW).when(size.isNull(), NONE).when(F.col("flat"), FLAT).otherwise(STUFFED)
    bytes_ = F.when(F.col("zero"), 1).when(raw.isNotNull() & (size.isNull() | (raw <= size)), raw).otherwise(size)
    found = found.select(*keys, "n", form.cast("int").alias("form"), bytes_.cast("long").alias("bytes"), ((form == STUFFED) & F.col("may_table")).alias("tabled"))
    one = F.struct("bytes", "form", "tabled", "n")
    pair = found.groupBy(*BLOCK).agg(F.max(F.when(~diff, one)).alias("own"), F.max(F.when(diff & (F.col("form") != NONE), one)).alias("change"))
    less = F.coalesce(F.col("change.bytes") < F.col("own.bytes"), F.lit(False))
    taken = F.when(less, F.col("change")).otherwise(F.col("own"))
    return pair.select(*BLOCK, taken["n"].alias("n"), taken["form"].alias("form"), taken["bytes"].alias("bytes"), taken["tabled"].alias("tabled"), less.alias("diff"))


def code_lengths(counts: Column) -> Column:
    """counts: an array of (symbol, n), each symbol once. The same with the bits of each symbol's Huffman code (length).

    A fold that joins the two rarest trees until one is left; of equally rare ones, that with the smaller least
    symbol comes first. Null where a code would be over 31 bits, or without symbols.
    """
    leaf = lambda c: F.struct(c["symbol"].cast("int").alias("symbol"), c["n"].cast("long").alias("n"), F.lit(0).alias("length"))
    tree = lambda n, least, leaves: F.struct(n.alias("n"), least.alias("least"), leaves.alias("leaves"))
    trees = F.array_sort(F.transform(counts, lambda c: tree(c["n"].cast("long"), c["symbol"].cast("int"), F.array(leaf(c)))))

    def join(held: Column, _: Column) -> Column:
        a, b = held[0], held[1]
        deeper = F.transform(F.concat(a["leaves"], b["leaves"]), lambda x: F.struct(x["symbol"].alias("symbol"), x["n"].alias("n"), (x["length"] + 1).alias("length")))
        return F.array_sort(F.concat(F.slice(held, 3, F.size(held)), F.array(tree(a["n"] + b["n"], F.least(a["least"], b["least"]), deeper))))

    steps = F.when(F.size(counts) > 1, F.sequence(F.lit(2), F.size(counts))).otherwise(F.array().cast("array<int>"))
    leaves = F.aggregate(steps, trees, join)[0]["leaves"]
    # A symbol on its own has a bit.
    found = F.transform(leaves, lambda x: F.struct(x["symbol"].alias("symbol"), x["n"].alias("n"), F.greatest(x["length"], F.lit(1)).alias("length")))
    return F.when((F.size(counts) > 0) & ~F.exists(found, lambda x: x["length"] > LONGEST_WRITTEN), F.array_sort(found))


def code_size(codes: Column) -> Column:
    """The bytes of a table of codes (as code_lengths() gives them, by symbol) and of the symbols coded with it."""
    total = lambda f: F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + f(x))
    span = (F.element_at(codes, -1)["symbol"] - codes[0]["symbol"] + 1).cast("long")
    longest = F.array_max(F.transform(codes, lambda x: x["length"]))
    lengths = 1 + F.when(span <= 255, 1).when(span <= 65535, 2).otherwise(4) + F.ceil(span * bits_required(longest) / 8)
    return (16 + lengths + 4 * F.ceil(total(lambda x: x["length"]) / 32) + 4 * (F.ceil(total(lambda x: x["n"] * x["length"]) / 32) + 1)).cast("long")


def _by_raster(histogram: DataFrame, name: str) -> DataFrame:
    return histogram.groupBy("raster_id").agg(code_lengths(F.collect_list(F.struct("symbol", "n"))).alias(name))


def huffman_plan(pixels: DataFrame, data_type: str) -> DataFrame:
    """raster_id, mode (2 plain, 1 differences from a neighbour), bytes, and codes (symbol, n, length) of the smaller
    coding of 8-bit samples, plain on ties. Rasters without a valid sample have no row."""
    shift = shift_of(data_type)
    moved = lambda df: df.withColumn("symbol", F.pmod(F.col("symbol") + shift, F.lit(256)))
    both = _by_raster(moved(tiles.histogram_plain(pixels)), "plain").join(_by_raster(moved(tiles.histogram_delta(pixels)), "delta"), "raster_id")
    both = both.withColumns({"plain_bytes": code_size(F.col("plain")), "delta_bytes": code_size(F.col("delta"))})
    delta = F.coalesce(F.col("delta_bytes") < F.col("plain_bytes"), F.col("plain").isNull())
    taken = lambda kind: F.when(delta, F.col(f"delta{kind}")).otherwise(F.col(f"plain{kind}"))
    found = both.select("raster_id", F.when(delta, 1).otherwise(2).alias("mode"), taken("_bytes").alias("bytes"), taken("").alias("codes"))
    return found.where("codes is not null")


def body_plan(pixels: DataFrame, error: float, data_type: str, micro: int = 8) -> DataFrame:
    """raster_id, body, micro, version, bytes: what the samples of each raster are written as, of any type, depth and
    error (zero only for floats), without no-data.

    constant: one value, or no valid sample; depths: one value in each dimension; tiles, with blocks doubled where
    that is no larger; huffman (8-bit samples and an error of 0.5); sweep: all samples as they are. bytes: of the body.
    """
    if error <= 0 and is_integer(data_type):
        raise ValueError("whole numbers have an error of 0.5 at least")
    ok = lambda c: F.when(F.col("valid"), F.col(c))
    by_dim = pixels.groupBy("raster_id", "dim").agg(F.max("y").alias("y"), F.max("x").alias("x"), F.count_if("valid").alias("valid"), F.min(ok("value")).alias("low"), F.max(ok("value")).alias("high"))
    found = by_dim.groupBy("raster_id").agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count(F.lit(1)).alias("depth"), F.sum("valid").alias("samples"),
        (F.min("low") == F.max("high")).alias("one"), F.bool_and(F.col("low") == F.col("high")).alias("each"),
    )
    for name, side in (("small", micro), ("large", 2 * micro)):
        sums = tile_plan(pixels, error, data_type, side).groupBy("raster_id").agg(F.sum("bytes").alias(name), F.count(F.lit(1)).alias("filled"), F.bool_or("diff").alias(f"{name}_diff"))
        empty = F.ceil(F.col("h") / side) * F.ceil(F.col("w") / side) * F.col("depth") - F.coalesce("filled", F.lit(0))  # a byte each
        found = found.join(sums, "raster_id", "left").withColumn(name, F.coalesce(name, F.lit(0)) + empty).withColumn(f"{name}_diff", F.coalesce(f"{name}_diff", F.lit(False))).drop("filled")
    if takes_huffman(data_type, error):
        coded = huffman_plan(pixels, data_type).select("raster_id", F.col("bytes").alias("coded"))
        found = found.join(coded, "raster_id", "left")
    else:
        found = found.withColumn("coded", F.lit(None).cast("long"))
    small, large, coded, sweep = F.col("small"), F.col("large"), F.col("coded"), F.col("samples") * dtype(data_type).itemsize
    coding = F.coalesce(coded < small, F.lit(False))
    room = (F.lit(2 * micro) <= LARGEST_BLOCK) & (F.greatest("h", "w") > micro)
    smooth = (8 * small < 1.5 * F.col("h") * F.col("w") * F.col("depth")) & (small < 4 * sweep) & F.coalesce(small < 2 * coded, F.lit(True))
    doubled = room & smooth & (large <= F.when(coding, coded).otherwise(small))
    tiled = F.when(doubled, large).otherwise(small)
    coding = coding & ~doubled
    changed = F.when(doubled, F.col("large_diff")).otherwise(F.col("small_diff"))
    total = F.when(coding, coded + 1).otherwise(tiled + int(takes_huffman(data_type, error)))
    constant, each = F.coalesce("one", F.lit(True)), F.coalesce("each", F.lit(True))
    body = F.when(constant, "constant").when(each, "depths").when(sweep <= total, "sweep").when(coding, "huffman").otherwise("tiles")
    plain = constant | each
    version = F.when(~plain & (body == "tiles") & changed, 5).otherwise(4)
    side = F.when(~plain & doubled, 2 * micro).otherwise(micro)
    size = F.when(plain, 0).otherwise(1 + F.least(sweep, total))
    return found.select("raster_id", body.alias("body"), side.cast("int").alias("micro"), version.cast("int").alias("version"), size.cast("long").alias("bytes"))
