"""Sentinels, mask policies and set errors as expressions, against the codec."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.codec import bands, writing
from rasterloom.codec.model import RasterError, type_range
from rasterloom.functions import blobs
from rasterloom.operators import nodata, sets


@pytest.mark.parametrize("kind", ["i8", "u8", "i16", "u32", "i32", "f32", "f64"])
def test_sentinels_are_the_writer_s(spark, kind):
    rng, rows = np.random.default_rng(5), []
    least, most = type_range(kind)
    for _ in range(400):
        if kind[0] == "f":
            low, high = np.sort(np.round(rng.normal(0, 10.0 ** rng.integers(0, 7), 2), 2)).tolist()
            error, original = float(rng.choice([0.0, 0.25, 3.0, 1e3])), float(rng.choice([low - 1, high + 1, -9999.0, 0.0, low, -1e30]))
        else:
            low, high = np.sort(rng.integers(int(least), int(most) + 1, 2)).astype(float).tolist()
            low, high = (least, high) if rng.random() < 0.3 else (low, most) if rng.random() < 0.3 else (low, high)
            error, original = float(rng.choice([0.5, 1.0, 7.0])), float(np.clip(rng.choice([low - 1, high + 1, least, most, low]), least, most))
        rows.append((low, high, original, error))
    df = spark.createDataFrame(rows, "low double, high double, original double, error double")
    got = df.select("*", nodata.sentinel(F.col("low"), F.col("high"), F.col("original"), F.col("error"), kind).alias("s")).collect()
    for r in got:
        assert (r.s.bound, r.s.encoded) == writing.choose_sentinel(kind, r.original, r.low, r.high, r.error), r


def test_rasters_without_mixed_pixels_need_no_sentinel(spark):
    rows = [(1, 0, x, d, -1.0 if x == 0 else 5.0 + d, True) for x in range(3) for d in range(2)] + [(2, 0, x, d, -1.0, True) for x in range(2) for d in range(2)]
    rows += [(3, 0, x, d, -1.0 if x + d == 1 else 5.0, x < 2) for x in range(3) for d in range(2)]
    pixels = spark.createDataFrame(rows, "raster_id int, y int, x int, dim int, value double, valid boolean")
    assert [r.raster_id for r in nodata.choices(pixels, -1.0, 0.25, "f64").collect()] == [3]
    stored = nodata.encoded(pixels, -1.0, 0.25, "f64")
    assert stored.where("raster_id = 1").count() == 4 and stored.where("raster_id = 2").count() == 0
    got = {(r.raster_id, r.x, r.dim): r.value for r in nodata.decoded(stored).collect()}
    assert got == {(i, x, d): v for i, _, x, d, v, ok in rows if ok and not (i == 1 and x == 0) and i != 2}
    assert nodata.choices(pixels.limit(0), -1.0, 0.25, "f64").count() == 0


def test_mask_encodings_are_those_of_real_sets(spark):
    rng, rows = np.random.default_rng(7), []
    for k in range(30):
        shared = rng.random((3, 4)) < 0.6
        for band in range(3):
            valid = {0: shared, 1: np.ones((3, 4), bool), 2: rng.random((3, 4)) < 0.5, 3: np.zeros((3, 4), bool), 4: shared}[k % 5]
            gone = rng.random((3, 4)) < (0.3 if k % 5 in (1, 4) and band == k % 3 and k % 2 else 0.0)
            rows += [(k, band, y, x, d, -1.0 if gone[y, x] else float(x + y + d), bool(valid[y, x])) for y in range(3) for x in range(4) for d in range(2)]
    pixels = spark.createDataFrame(rows, "raster_id int, band int, y int, x int, dim int, value double, valid boolean").repartition(4)
    made = blobs.split_bands(blobs.encode_bands(pixels, "i16", writing.Options(0.5, 8, -1.0)))
    want = {(r.blob_id, r.band): (r.valid_pixel_count, r.mask_encoding) for r in made.collect()}
    got = {(r.raster_id, r.band): (r.n_valid, r.mask_encoding) for r in sets.mask_encodings(pixels, -1.0).collect()}
    assert got == want and {m for _, m in want.values()} == {"None", "Explicit", "External", "ImplicitAllInvalid"}


def test_set_errors_are_the_codec_s(spark):
    """Sets in which bands are dropped, swapped, of another shape or type, or damaged."""
    rng, made = np.random.default_rng(9), []
    value = np.where(rng.random((4, 4, 2)) < 0.3, -1.0, 7.0)
    six = [writing.blob(p, False, 2 - i) for i, p in enumerate(writing.prepare_bands([value + k * (value > 0) for k in range(3)], "i16", None, writing.Options(0.5, 8, -1.0)))]
    four = [writing.encode(np.arange(12).reshape(3, 4) + k, "u8") for k in range(3)]
    made = [six, six[:2], [six[1], six[0], six[2]], six[1:], four, four[:1], [*four, writing.encode(np.ones((2, 2)), "u8")], [four[0], writing.encode(np.arange(12).reshape(3, 4), "i8")], [*six, four[0]], [four[0], b"junk and more"], [four[0], four[1][:-1]]]
    df = spark.createDataFrame([(k, bytearray(b"".join(parts))) for k, parts in enumerate(made)], "blob_id int, content binary")
    split = blobs.split_bands(df).cache()
    got = {r.blob_id: r for r in sets.set_errors(split).collect()}
    for k, parts in enumerate(made):
        try:
            assert got[k].n_bands == bands.band_count(b"".join(parts)) and got[k].error_kind is None and got[k]["at"] is None
        except RasterError as e:
            assert got[k].error_kind == e.kind and got[k]["at"] is not None, k
    kept = {r.blob_id for r in sets.sound(split).select("blob_id").collect()}
    assert kept == {k for k, r in got.items() if r.error_kind is None} == {0, 3, 4, 5} | ({1} & kept)


def test_masks_of_sets_and_permissive_types(spark):
    mask = np.array([1, 0, 1, 1])
    shared = writing.encode_bands([np.eye(2), np.ones((2, 2))], "u8", mask)
    bare = writing.encode_bands([np.eye(2), np.ones((2, 2))], "u8")
    mixed = writing.encode(np.eye(2), "u8", mask) + writing.encode(np.eye(2), "u8")
    rows = [(1, bytearray(shared)), (2, bytearray(bare)), (3, bytearray(mixed)), (4, None)]
    df = spark.createDataFrame(rows, "blob_id int, content binary")
    got = {r.blob_id: (r["shape"], None if r.masks is None else bytes(r.masks)) for r in blobs.set_masks(df).collect()}
    pairs = lambda a, b: bytes(v for p in zip(a, b) for v in p)
    assert got == {1: ([2, 2, 2], pairs(mask, mask)), 2: (None, None), 3: ([2, 2, 2], pairs(mask, [1] * 4)), 4: (None, None)}
    some = df.unionByName(spark.createDataFrame([(5, bytearray(b"junk")), (6, bytearray(writing.encode(np.eye(2), "i16")))], df.schema))
    found = {r.blob_id: r.samples for r in blobs.decode_native(some, "u8", permissive=True).collect()}
    assert found[2] == [1, 0, 0, 1] and found[5] is None and found[6] is None and found[4] is None
    with pytest.raises(Exception, match="Invalid"):
        blobs.decode_native(some, "u8").collect()
