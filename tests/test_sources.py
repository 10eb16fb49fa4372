"""The data source, the streaming decoder, and plans that stay in the JVM."""

import numpy as np
import pytest

from rasterloom.codec import writing
from rasterloom.functions import blobs
from rasterloom.operators import tiles
from rasterloom.sources import rasters
from rasterloom.sources.datasource import RasterSource
from rasterloom.streaming.frames import decode_stream

MASK = np.array([1, 0, 1, 1])
SET = writing.encode_bands([np.array([[10, 0], [11, 12]]), np.array([[50, 0], [51, 52]])], "u8", MASK)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.blob").write_bytes(SET)
    (tmp_path / "b.blob").write_bytes(writing.encode(np.arange(12).reshape(3, 4), "i16"))
    (tmp_path / "c.blob").write_bytes(SET[:40])
    return tmp_path


def test_batch_read(spark, folder):
    spark.dataSource.register(RasterSource)
    df = spark.read.format("rasterloom").load(str(folder))
    found = {(r.path[-6:], r.band): r for r in df.collect()}
    assert found["a.blob", 1]["values"] == [50.0, 0.0, 51.0, 52.0] and bytes(found["a.blob", 1].mask) == bytes(MASK.tolist())
    assert found["b.blob", 0].width == 4 and found["c.blob", 0].error_kind == "Truncated"
    assert spark.read.format("rasterloom").option("pixels", "false").load(str(folder)).where("values is not null").count() == 0
    assert spark.read.format("rasterloom").option("mode", "DROPMALFORMED").load(str(folder)).count() == 3
    with pytest.raises(Exception, match="Truncated"):
        spark.read.format("rasterloom").option("mode", "FAILFAST").load(str(folder)).collect()


def test_filters_are_taken_over(spark, folder):
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("rasterloom").option("pushFilters", "true").load(str(folder)).where("width > 2 and data_type = 'i16'")
        assert [r.path[-6:] for r in df.collect()] == ["b.blob"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_write_and_stream(spark, tmp_path):
    spark.dataSource.register(RasterSource)
    rows = spark.createDataFrame([("one", bytearray(SET)), ("two", bytearray(SET))], "blob_id string, content binary")
    rows.write.format("rasterloom").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("rasterloom").load(str(tmp_path / "out")).count() == 4
    query = spark.readStream.format("rasterloom").load(str(tmp_path / "out")).writeStream.format("memory").queryName("bands_read").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        assert spark.table("bands_read").count() == 4
    finally:
        query.stop()


def test_late_files_odd_names_and_overwriting(spark, tmp_path):
    spark.dataSource.register(RasterSource)
    out = str(tmp_path / "late")
    blob = bytearray(writing.encode(np.arange(4).reshape(2, 2), "u8"))
    put = lambda mode, *names: spark.createDataFrame([(n, blob) for n in names], "blob_id string, content binary").write.format("rasterloom").mode(mode).save(out)
    put("append", "m", "a/../b c")
    start = lambda: spark.readStream.format("rasterloom").load(out).writeStream.format("memory").queryName("late_read").outputMode("append").option("checkpointLocation", str(tmp_path / "late_ck")).start()
    query = start()
    try:
        query.processAllAvailable()
        assert spark.table("late_read").count() == 2
        put("append", "c")  # before m in order
        query.processAllAvailable()
        assert spark.table("late_read").count() == 3
    finally:
        query.stop()
    put("overwrite", "z")
    assert [r.path.rpartition("/")[2] for r in spark.read.format("rasterloom").load(out).collect()] == ["z.blob"]
    with pytest.raises(Exception):
        put("append", "same", "same")


def test_bands_of_different_extents_null_blobs_and_native_types(spark):
    rows = [(1, b, y, x, 0, float(10 * b + y + x), True) for b, size in ((0, 2), (1, 3)) for y in range(size) for x in range(size)]
    source = spark.createDataFrame(rows, "raster_id long, band int, y int, x int, dim int, value double, valid boolean")
    found = blobs.encode_bands(source, "f32")
    got = blobs.pixels(found).where("valid").select("band", "y", "x", "value").collect()
    assert sorted(map(tuple, got)) == sorted((r[1], r[2], r[3], r[5]) for r in rows)
    shared = blobs.split_bands(blobs.encode_bands(source.where("band = 1").unionByName(source.where("band = 1").withColumn("band", source.band * 0)).where("x < 2 or y < 2"), "f32")).orderBy("band").collect()
    assert [r.mask_encoding for r in shared] == ["Explicit", "External"] and shared[0].band_mask == shared[1].band_mask
    some = found.unionByName(spark.createDataFrame([(2, None), (3, bytearray(b"junk"))], "blob_id long, content binary"))
    assert {r.blob_id for r in blobs.pixels(some, permissive=True).collect()} == {1}
    assert {(r.blob_id, r.error_kind is None) for r in blobs.decode(some, strict=False).collect()} == {(1, True), (2, True), (3, False)}
    assert blobs.split_bands(some).count() == 4
    one = blobs.encode(source.where("band = 1"), "u16")
    assert blobs.decode_native(one, "u16").select("shape", "samples").first() == ([3, 3], [10 + 1 * k % 3 + k // 3 for k in range(9)])
    assert one.select(blobs.mask_bytes("content")).first()[0] is None
    with pytest.raises(Exception, match="more than one row"):
        blobs.encode(source.where("band = 1").unionByName(source.where("band = 1")), "u8").collect()


def test_masks_are_handed_on_between_batches(spark, tmp_path):
    first = len(writing.encode(np.array([[10, 0], [11, 12]]), "u8", MASK))
    source = tmp_path / "in"
    part = lambda band, data: spark.createDataFrame([(1, band, bytearray(data))], "blob_id long, band int, content binary").coalesce(1).write.mode("append").parquet(str(source))
    part(0, SET[:first])
    stream = spark.readStream.schema("blob_id long, band int, content binary").parquet(str(source))
    query = decode_stream(stream).writeStream.format("memory").queryName("handed_on").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        part(1, SET[first:])
        query.processAllAvailable()
        found = {r.band: r for r in spark.table("handed_on").collect()}
        assert found[1].error_kind is None and found[1]["values"] == [50.0, 0.0, 51.0, 52.0]
    finally:
        query.stop()


def test_metadata_needs_no_samples_and_errors_are_rows(spark):
    rows = spark.createDataFrame([(1, bytearray(SET)), (2, bytearray(b"junk")), (3, None)], "blob_id long, content binary")
    found = {r.blob_id: r.i for r in rows.withColumn("i", blobs.inspect(blobs.F.col("content"))).collect()}
    assert found[1].width == 2 and found[2].error_kind == "InvalidMagic" and found[3].width is None
    split = blobs.split_bands(rows.where("blob_id < 3"))
    assert sorted((r.blob_id, r.band, r.error_kind) for r in split.collect()) == [(1, 0, None), (1, 1, None), (2, 0, "InvalidMagic")]
    decoded = {r.blob_id: r for r in blobs.decode(rows.where("blob_id = 1")).collect()}
    assert decoded[1].error_kind == "InvalidBlob"  # a second band lies behind the first
    assert blobs.decode(rows.where("blob_id = 1"), strict=False).first()["values"] == [10.0, 0.0, 11.0, 12.0]


def test_planning_runs_no_python(spark):
    plan = tiles.tile_plan(rasters.events(spark, "/root/testdata/sf0.001"), 0.5, "f64")
    assert not any(w in plan._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


def _many(n=1000):
    """Blobs of many kinds that follow one another: masks of their own, taken over, and none."""
    rng, out = np.random.default_rng(1), []
    while len(out) < n:
        mask = rng.random((6, 7)) < 0.7
        rasters_ = [rng.integers(0, 50, (6, 7)).astype(float) + k for k in range(3)]
        parts = [writing.blob(p, False, 2 - k) for k, p in enumerate(writing.prepare_bands(rasters_, "i16", mask, writing.Options(0.5)))]
        out += [*parts, writing.encode(rasters_[0] / 8, "f32"), writing.encode(np.zeros((2, 2)), "u8", np.zeros((2, 2)))]
    return out[:n]


def test_one_file_is_many_tasks(spark, tmp_path):
    from rasterloom.sources import ranges

    spark.dataSource.register(RasterSource)
    made = _many()
    (tmp_path / "all.blob").write_bytes(b"".join(made))
    index = list(ranges.hop(str(tmp_path / "all.blob")))
    assert [e.length for e in index] == list(map(len, made)) and [e.at for e in index] == np.cumsum([0, *map(len, made)])[:-1].tolist()
    df = spark.read.format("rasterloom").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 8
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select(blobs.F.lit(1).alias("blob_id"), "content")
    want = {(r.band, r.mask_encoding, r.valid_pixel_count, None if r.band_mask is None else bytes(r.band_mask)) for r in blobs.split_bands(whole).collect()}
    got = df.collect()
    assert {(r.band, r.mask_encoding, r.valid_pixel_count, None if r.mask is None else bytes(r.mask)) for r in got} == want and len(got) == 1000
    assert {r.mask_encoding for r in got} == {"None", "Explicit", "External", "ImplicitAllInvalid"} and all(r.error_kind is None for r in got)
    by_band = {r.band: r["values"] for r in got}
    for r in blobs.decode(spark.createDataFrame([(k, bytearray(made[k])) for k in (0, 3, 500, 998)], "blob_id int, content binary")).where("values is not null").collect():
        assert by_band[r.blob_id] == list(r["values"])


def test_groups_of_ranges_are_balanced():
    from rasterloom.sources import ranges

    sizes = [10, 400, 30, 30, 1000, 5, 5, 5, 90] * 40
    entries = [ranges.Entry(f"f{k // 100}", k % 100, sum(sizes[k // 100 * 100 : k]), n) for k, n in enumerate(sizes)]
    groups = ranges.balanced(entries, 2000, 4, 900)
    held = [sum(r.length for r in g) for g in groups]
    assert sum(held) == sum(sizes) and max(held) <= 2000 + 1000 and len(groups) >= sum(sizes) / 2000 - 1
    assert all(r.over == (r.length == 1000) for g in groups for r in g if r.over or r.length == 1000)
    assert ranges.balanced([], 100, 4) == []


def test_damaged_ends_large_blobs_and_empty_files(spark, tmp_path):
    spark.dataSource.register(RasterSource)
    made = _many(10)
    (tmp_path / "cut.blob").write_bytes(b"".join(made)[:-3])
    (tmp_path / "junk.blob").write_bytes(made[0] + b"junk" + made[1])
    (tmp_path / "none.blob").write_bytes(b"")
    (tmp_path / "short.blob").write_bytes(b"Lerc")
    found = spark.read.format("rasterloom").load(str(tmp_path)).select("path", "band", "error_kind").collect()
    bad = {(r.path.rpartition("/")[2], r.band, r.error_kind) for r in found if r.error_kind}
    assert bad == {("cut.blob", 9, "Truncated"), ("junk.blob", 1, "InvalidMagic"), ("none.blob", 0, "InvalidBlob"), ("short.blob", 0, "InvalidMagic")}
    assert len(found) == 9 + 1 + 4
    limit = max(map(len, made)) - 1
    found = spark.read.format("rasterloom").option("maxBlobBytes", limit).load(str(tmp_path / "cut.blob")).collect()
    assert {r.error_kind for r in found} == {None, "InvalidBlob", "Truncated"} and sum(r.error_kind is None for r in found) == sum(len(m) <= limit for m in made[:-1])


def test_first_family_is_hopped_over(tmp_path):
    """A blob with a mask of its own, one that takes it over, one without masks, and one of nothing but invalid pixels."""
    import struct

    from rasterloom.codec import bands, masks
    from rasterloom.sources import ranges

    head = b"CntZImage " + struct.pack("<iiIId", 11, 8, 2, 2, 0.5)
    section = lambda by, bx, data, top: struct.pack("<IIIf", by, bx, len(data), top) + data
    pixels = lambda *values: section(1, 1, b"\0" + struct.pack(f"<{len(values)}f", *values), 9.0)
    runs = masks.write_runs(masks.pack(MASK == 1))
    made = [head + section(0, 0, runs, 1.0) + pixels(1, 2, 3), head + pixels(4, 5, 6), head + section(0, 0, b"", 1.0) + pixels(1, 2, 3, 4), head + section(0, 0, b"", 0.0) + pixels()]
    (tmp_path / "old.blob").write_bytes(b"".join(made))
    index = list(ranges.hop(str(tmp_path / "old.blob")))
    assert [e.length for e in index] == list(map(len, made)) == [b.info.blob_size for b in bands.each(b"".join(made), samples=False)]
    assert [e.mask_at for e in index] == [-1, 0, -1, -1]


def test_a_stream_s_offset_does_not_grow(spark, tmp_path):
    from rasterloom.sources.datasource import StreamReader

    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir()
    reader = StreamReader({"path": str(folder), "log": str(log)})
    assert reader.latestOffset() == reader.initialOffset()
    blob, sizes, before = _many(1)[0], set(), reader.initialOffset()
    for k in range(0, 1000, 100):
        for i in range(k, k + 100):
            (folder / f"f{999 - i}.blob").write_bytes(blob)
        now = reader.latestOffset()
        assert len([r for p in reader.partitions(before, now) for r in p.of]) == 100
        sizes.add(len(str(now)))
        before = now
    assert max(sizes) - min(sizes) <= 1 and reader.latestOffset() == before
    # Another reader of the same log plans the same batches.
    again = StreamReader({"path": str(folder), "log": str(log)})
    paths = lambda r, a, b: [x.path for p in r.partitions({"place": a}, {"place": b}) for x in p.of]
    assert paths(again, 3, 4) == paths(reader, 3, 4) and again.latestOffset() == before
