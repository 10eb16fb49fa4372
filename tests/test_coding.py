"""Bytes made by expressions against the codec's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.codec import bits, huffman, masks
from rasterloom.operators import coding, tiles


@pytest.mark.parametrize("strict", [False, True])
def test_masks_are_coded_as_by_the_codec(spark, strict):
    rng = np.random.default_rng(6)
    made = [bytes([n % 251]) * n for n in (1, 2, 3, 4, 5, 6, 32_767, 70_000)]
    for _ in range(60):
        lengths = rng.choice([1, 1, 2, 3, 4, 4, 5, 5, 6, 7, 30], rng.integers(1, 30))
        values = np.cumsum(rng.integers(1, 200, len(lengths))) % 256
        made.append(b"".join(bytes([v]) * n for v, n in zip(values.tolist(), lengths.tolist())))
    made.append(bytes(rng.integers(0, 256, 33_000).astype(np.uint8)) + b"\7" * 9)
    rows = spark.createDataFrame([(k, bytearray(raw).hex()) for k, raw in enumerate(made)], "raster_id int, digits string")
    df = rows.select("raster_id", F.posexplode(F.split(F.regexp_replace("digits", "(..)(?!$)", "$1,"), ",")).alias("byte", "two")).select("raster_id", "byte", F.conv("two", 16, 10).cast("long").alias("bits"))
    got = {r.raster_id: bytes(r.coded) for r in coding.coded_masks(df, strict).collect()}
    for k, raw in enumerate(made):
        assert got[k] == (masks.write_strict_runs if strict else masks.write_runs)(raw), k
    assert coding.coded_masks(df.limit(0)).count() == 0


def test_packing_is_the_codec_s(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for k in range(120):
        wide, n = int(rng.integers(0, 33)), int(rng.integers(1, 200))
        levels = rng.integers(0, 1 << wide, n) if wide else np.zeros(n, np.int64)
        want[k] = (levels.tolist(), bits.pack_low(levels, wide) if wide else b"", wide)
        rows += [(k, i, int(v), wide) for i, v in enumerate(levels)]
    made = coding.packed(spark.createDataFrame(rows, "k int, place int, level long, bits int").repartition(5), ["k"])
    got = {r.k: r for r in made.withColumn("back", coding.unpacked(F.col("packed"), F.col("n"), F.col("bits"))).collect()}
    for k, (levels, raw, wide) in want.items():
        assert bytes(got[k].packed) == raw and got[k].back == levels and got[k].n == len(levels) and got[k].bits == wide
    wide = spark.createDataFrame([(1, i, (1 << 57) - 1 - i, 57) for i in range(9)], "k int, place int, level long, bits int")
    made = coding.packed(wide, ["k"])
    assert made.select(coding.unpacked(F.col("packed"), F.col("n"), F.col("bits"))).first()[0] == [(1 << 57) - 1 - i for i in range(9)]
    empty = spark.createDataFrame([(bytearray(), 0, 5)], "packed binary, n long, bits int")
    assert empty.select(coding.unpacked(F.col("packed"), F.col("n"), F.col("bits"))).first()[0] == []


def test_differences_are_restored(spark):
    """All shapes of masks: rows that begin late, lone pixels, empty rows, nothing valid."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for k in range(40):
        h, w = rng.integers(1, 12, 2)
        values, valid = rng.integers(0, 256, (h, w, 2)), rng.random((h, w)) < (0.05, 0.3, 0.6, 0.95, 1.0)[k % 5]
        rows += [(k, y, x, d, float(values[y, x, d]), bool(valid[y, x])) for y in range(h) for x in range(w) for d in range(2)]
        want |= {(k, y, x, d): int(values[y, x, d]) for y, x in np.argwhere(valid).tolist() for d in range(2)}
        symbols = huffman.differences(values, valid, 0)
        want |= {("s", k, d): symbols[d].tolist() for d in range(2) if valid.any()}
    pixels = spark.createDataFrame(rows, "raster_id int, y int, x int, dim int, value double, valid boolean").repartition(4)
    symbols = tiles.delta_symbols(pixels).cache()
    found = {}
    for r in symbols.orderBy("raster_id", "dim", "y", "x").collect():
        found.setdefault(("s", r.raster_id, r.dim), []).append(r.symbol)
    assert found == {k: v for k, v in want.items() if k[0] == "s"}
    got = {(r.raster_id, r.y, r.x, r.dim): r.value for r in coding.delta_restored(symbols).collect()}
    assert got == {k: v for k, v in want.items() if k[0] != "s"}


def test_no_python_runs(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0, 5.0, True)], "raster_id int, y int, x int, dim int, value double, valid boolean")
    levels = coding.block_levels(pixels, 0.5)
    mask = tiles.mask_bytes(pixels, 8)
    for df in (coding.packed(levels, coding.BLOCK), coding.coded_masks(mask), coding.delta_restored(tiles.delta_symbols(pixels))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
