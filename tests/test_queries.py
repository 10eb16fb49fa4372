"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from rasterloom.plans import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame = frame.assign(**{c: frame[c].round(9)})
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_damaged_blobs_tell_their_errors(spark):
    found = {r.name: r.error_kind for r in queries.validate_malformed(spark, SF).collect()}
    assert found == queries._DAMAGE and found["sound"] is None and found["checksum"] == "ChecksumMismatch" and found["cut"] == "Truncated" and found["more behind"] == "InvalidBlob"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_checksums_of_all_lengths(spark):
    """Odd lengths too, as the codec's own."""
    from pyspark.sql import functions as F

    from rasterloom.codec import bits
    from rasterloom.operators import tiles

    raws = [b"", b"a", b"ab", b"click", b"error", b"\xff" * 7, b"\x00", bytes(range(256)) * 4 + b"z"]
    got = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(raws)], "k int, content binary").select("k", tiles.checksum(F.col("content")).cast("long").alias("c"))
    assert {r.k: r.c for r in got.collect()} == {k: bits.fletcher32(r) for k, r in enumerate(raws)}
    assert queries.checksum_fletcher32_all(spark, SF).count() == queries.rasters.table(spark, SF, "events").count()


def test_bodies_are_those_of_the_blobs(spark):
    """Predicted sizes against real blobs: an i32 of one dimension has 66 bytes of header, 4 for the mask's size, 8 of ranges unless constant."""
    from pyspark.sql import functions as F

    from rasterloom.codec import writing
    from rasterloom.functions import blobs

    pixels = queries._bodies(spark, "/root/testdata/sf0.01")
    plan = {r.raster_id: r for r in queries.tiles.body_choice(pixels, 0.5, "i32").collect()}
    found = blobs.encode(pixels, "i32", writing.Options(0.5)).select("blob_id", F.length("content").alias("n"), blobs.inspect(F.col("content")).alias("i")).collect()
    assert {p.body for p in plan.values()} == {"constant", "sweep", "tiles"} and {p.micro for p in plan.values()} == {8, 16}
    for r in found:
        p = plan[r.blob_id]
        if r.i.mask_encoding == "None":
            assert r.n == 70 + (8 if p.body != "constant" else 0) + p.bytes and (p.body != "tiles" or r.i.micro_block_size == p.micro)
