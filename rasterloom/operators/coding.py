"""Bytes of blobs as DataFrame expressions: bit packing and back, run coding of masks, and differences restored.

Numbers are dealt to the 64-bit words that have their bits, words are aggregated with bit_or; runs of a mask
become literals and repeats by windows; differences become samples by modular prefix sums. No Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.codec.masks import ALONE, AT_AN_END, BETWEEN, LONGEST, STRICT_REPEAT
from rasterloom.operators import tiles
from rasterloom.operators.tiles import BLOCK, bits_required

WORD = 64


def block_levels(pixels: DataFrame, error: float, micro: int = 8) -> DataFrame:
    """BLOCK, place (of a sample among its block's valid ones, row by row), level and bits (what the block's largest level needs)."""
    rows = tiles.quantised(pixels, error, micro)
    order = Window.partitionBy(*BLOCK).orderBy("y", "x")
    bits = bits_required(F.max("level").over(Window.partitionBy(*BLOCK)))
    return rows.select(*BLOCK, (F.row_number().over(order) - 1).alias("place"), "level", bits.cast("int").alias("bits"))


def word_octets(word: Column) -> Column:
    """The 16 hexadecimal digits of a word's bytes, the lowest first."""
    digits = F.lpad(F.hex(word), 16, "0")
    return F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)])


def packed(levels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, bits and packed (binary): the levels of each group by place, each in so many bits, the lowest first.

    A level's bits lie in one word or two; both parts are dealt out and added up by bit_or, with map-side
    combining. No bits make no bytes. Levels must be below 2**bits, and bits at most 63.
    """
    at = F.col("place").cast("long") * F.col("bits")
    rows = levels.select(*keys, "bits", "level", F.floor(at / WORD).alias("word"), F.pmod(at, F.lit(WORD)).cast("int").alias("shift"))
    low = F.struct("word", F.call_function("shiftleft", F.col("level"), F.col("shift")).alias("part"), F.lit(1).alias("one"))
    # A shift by 64 is none, so the second part is made only where bits run over.
    high = F.struct((F.col("word") + 1).alias("word"), F.call_function("shiftrightunsigned", F.col("level"), WORD - F.col("shift")).alias("part"), F.lit(0).alias("one"))
    parts = F.when(F.col("shift") + F.col("bits") > WORD, F.array(low, high)).otherwise(F.array(low))
    words = rows.select(*keys, "bits", F.inline(parts)).groupBy(*keys, "bits", "word").agg(F.bit_or("part").alias("bits_of_word"), F.sum("one").alias("n"))
    found = words.groupBy(*keys, "bits").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("word", "bits_of_word"))).alias("words"))
    digits = F.array_join(F.transform("words", lambda w: word_octets(w["bits_of_word"])), "")
    size = F.ceil(F.col("n") * F.col("bits") / 8).cast("int")
    return found.select(*keys, F.col("n").cast("long").alias("n"), "bits", F.unhex(F.substr(digits, F.lit(1), 2 * size)).alias("packed"))


def unpacked(content: Column, n: Column, bits: Column) -> Column:
    """The n numbers of bits each (at most 57) in packed bytes, as an array. A number is cut out of its word and the next one's first bits."""
    digits = F.hex(content)

    def word(k: Column) -> Column:
        octets = [F.substr(F.rpad(F.substr(digits, 16 * k + 1, F.lit(16)), 16, "0"), F.lit(2 * i + 1), F.lit(2)) for i in range(8)]
        half = lambda part: F.conv(F.concat(*reversed(part)), 16, 10).cast("long")
        return F.call_function("shiftleft", half(octets[4:]), F.lit(32)).bitwiseOR(half(octets[:4]))

    count = F.ceil(F.length(content) / 8).cast("int")
    words = F.when(count > 0, F.transform(F.sequence(F.lit(0), count), lambda k: F.when(k < count, word(k)).otherwise(F.lit(0).cast("long"))))

    def cut(held: Column) -> Column:
        def one(i: Column) -> Column:
            at = i.cast("long") * bits
            k, shift = F.floor(at / WORD).cast("int"), F.pmod(at, F.lit(WORD)).cast("int")
            low = F.call_function("shiftrightunsigned", held[k], shift)
            high = F.when(shift > 0, F.call_function("shiftleft", held[k + 1], WORD - shift)).otherwise(F.lit(0).cast("long"))
            return low.bitwiseOR(high).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)

        return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), one)

    none = F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(bits == 0, none).otherwise(F.transform(F.array(words), cut)[0])


def mask_segments(mask: DataFrame, strict: bool = False) -> DataFrame:
    """raster_id, begin, kind (literal or repeat), length and value (of a repeat) of the segments that code each mask.

    mask: raster_id, byte, bits, as tiles.mask_bytes() makes it. A run of equal bytes is a repeat if it is long enough:
    6 bytes between literals, 4 at one end of the mask or behind a repeat, 2 if both hold. Only runs of 4 and 5
    bytes depend on what is before them: they go as the nearest earlier run of another length does. strict: over 5
    bytes, or 5 that don't end the mask. Both kinds are split at 32,767 bytes.
    """
    order = Window.partitionBy("raster_id").orderBy("begin")
    runs = tiles.mask_runs(mask).select("raster_id", "begin", "length", "bits", (F.lead("begin").over(order)).isNull().alias("ends"))
    n = F.col("length")
    if strict:
        taken = (n > STRICT_REPEAT) | (n == STRICT_REPEAT) & ~F.col("ends")
    else:
        depends = (n >= AT_AN_END) & (n < BETWEEN)
        earlier = F.last(F.when(~depends, n >= BETWEEN), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        behind = F.coalesce(earlier, F.lit(True))  # the start is as a repeat before
        taken = F.when(F.col("ends"), n >= F.when(behind, ALONE).otherwise(AT_AN_END)).when(depends, behind).otherwise(n >= BETWEEN)
    rows = runs.withColumn("taken", taken)
    # A repeat is a segment of its own; the runs between two repeats are one literal.
    rows = rows.withColumn("after", F.sum(F.col("taken").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("raster_id", "after", "taken").agg(F.min("begin").alias("begin"), F.sum("length").alias("length"), F.first("bits").alias("bits"))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / LONGEST)))
    found = found.withColumn("k", place)
    size = F.least(F.col("length") - F.col("k") * LONGEST, F.lit(LONGEST))
    kind = F.when(F.col("taken"), "repeat").otherwise("literal")
    return found.select("raster_id", (F.col("begin") + F.col("k") * LONGEST).alias("begin"), kind.alias("kind"), size.cast("long").alias("length"), F.when(F.col("taken"), F.col("bits")).alias("value"))


def coded_masks(mask: DataFrame, strict: bool = False) -> DataFrame:
    """raster_id and coded (binary): each mask's segments with their heads, and the end mark."""
    segments = mask_segments(mask, strict)
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    head = lambda v: F.concat(two(F.pmod(v, F.lit(256))), two(F.floor(F.pmod(v, F.lit(65536)) / 256)))
    octets = mask.groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct("byte", "bits"))).alias("all"))
    octets = octets.select("raster_id", F.array_join(F.transform("all", lambda b: two(b["bits"])), "").alias("digits"))
    listed = segments.groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct("begin", "kind", "length", "value"))).alias("segments"))
    both = listed.join(octets, "raster_id")
    literal = lambda s: F.concat(head(s["length"]), F.substr(F.col("digits"), (2 * s["begin"] + 1).cast("int"), (2 * s["length"]).cast("int")))
    text = F.transform("segments", lambda s: F.when(s["kind"] == "repeat", F.concat(head(-s["length"]), two(s["value"]))).otherwise(literal(s)))
    return both.select("raster_id", F.unhex(F.concat(F.array_join(text, ""), F.lit("0080"))).alias("coded"))


def delta_restored(symbols: DataFrame) -> DataFrame:
    """raster_id, dim, y, x and value (modulo 256) of symbols (as tiles.delta_symbols() makes them, of valid samples).

    A row's valid samples that follow one another are an island; within it, samples are prefix sums above its first
    one. That one stands above the sample over it, or else over the last one before it in the raster. So islands
    refer to earlier islands, and one fold over a raster's islands (not its samples) settles all of them.
    """
    row = Window.partitionBy("raster_id", "dim", "y").orderBy("x")
    scan = Window.partitionBy("raster_id", "dim").orderBy("y", "x")
    column = Window.partitionBy("raster_id", "dim", "x").orderBy("y")
    begins = F.coalesce(F.lag("x").over(row) != F.col("x") - 1, F.lit(True))
    rows = symbols.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(scan))
    inside = Window.partitionBy("raster_id", "dim", "island").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("above_first", F.sum(F.when(~F.col("begins"), F.col("symbol")).otherwise(0)).over(inside))
    own = F.struct("island", "above_first")
    over = F.when(F.lag("y").over(column) == F.col("y") - 1, F.lag(own).over(column))
    rows = rows.withColumn("from", F.when(F.col("begins"), F.coalesce(over, F.lag(own).over(scan))))
    heads = rows.where("begins").groupBy("raster_id", "dim").agg(F.array_sort(F.collect_list(F.struct("island", "symbol", F.col("from.island").alias("from_island"), F.col("from.above_first").alias("from_above")))).alias("heads"))

    def settle(done: Column, h: Column) -> Column:
        base = F.when(h["from_island"].isNull(), F.lit(0).cast("long")).otherwise(F.element_at(done, h["from_island"].cast("int")) + h["from_above"])
        return F.concat(done, F.array(F.pmod(base + h["symbol"], F.lit(256).cast("long"))))

    settled = heads.select("raster_id", "dim", F.posexplode(F.aggregate("heads", F.array().cast("array<bigint>"), settle)).alias("k", "first"))
    settled = settled.select("raster_id", "dim", (F.col("k") + 1).cast("long").alias("island"), "first")
    found = rows.join(settled, ["raster_id", "dim", "island"])
    return found.select("raster_id", "dim", "y", "x", F.pmod(F.col("first") + F.col("above_first"), F.lit(256).cast("long")).alias("value"))
