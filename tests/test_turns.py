"""Bands that arrive out of order, over several batches."""

import time

import numpy as np
import pytest

from rasterloom.codec import writing
from rasterloom.streaming.turns import decode_in_turn

MASK = np.array([1, 0, 1, 1])
SCHEMA = "blob_id string, band int, content binary"


def bands_of(k):
    found = writing.prepare_bands([np.array([[10 * b + k, 0], [11, 12]]) for b in range(4)], "u8", MASK, writing.Options(0.5))
    return [writing.blob(p, False, 3 - i) for i, p in enumerate(found)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, batches, name, keep_ms, wait=0.0):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    query = decode_in_turn(stream, keep_ms=keep_ms).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    found, held = [], []
    try:
        for rows, wanted in batches:
            spark.createDataFrame([(k, b, None if c is None else bytearray(c)) for k, b, c in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            # With processing time there is always another batch, so all that is there is never done.
            until = time.time() + 60
            while spark.table(name).count() < wanted and time.time() < until and query.isActive:
                time.sleep(0.3)
            found.append(spark.table(name).collect())
            time.sleep(wait)
            recent = query.recentProgress[-int(3 * wait) - 4 :]
            held.append(max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in recent))
    finally:
        query.stop()
    return found, held


def test_bands_wait_for_their_turn(rocks, tmp_path):
    a, b = bands_of(1), bands_of(2)
    batches = [[("a", 2, a[2]), ("a", 1, a[1]), ("b", 0, b[0])], [("b", 3, b[3]), ("a", 0, a[0])], [("b", 1, b[1]), ("a", 1, a[1]), ("b", 2, b"junk"), ("a", 3, a[3]), ("a", None, a[0]), ("b", 9, None)]]
    found, _ = run(rocks, tmp_path, zip(batches, (1, 4, 11)), "in_turn", 3_600_000)
    assert [(r.blob_id, r.band) for r in found[0]] == [("b", 0)]
    assert {(r.blob_id, r.band) for r in found[1]} == {("b", 0), ("a", 0), ("a", 1), ("a", 2)}
    last = {(r.blob_id, r.band, r.error_kind): r for r in found[2]}
    for k in range(4):
        assert list(last["a", k, None]["values"]) == [10.0 * k + 1, 0.0, 11.0, 12.0] and bytes(last["a", k, None].valid) == bytes(MASK.tolist())
    assert ("a", 1, "InvalidArgument") in last and ("a", None, "InvalidArgument") in last and ("b", 9, "InvalidArgument") in last
    assert ("b", 2, "InvalidMagic") in last and ("b", 3, "UnsupportedFeature") in last  # the mask of a broken band isn't handed on


def test_state_expires(rocks, tmp_path):
    """Sets that are never ended don't stay: after many sets, only those of the last batches are held."""
    batches = [[(f"{n}-{k}", band, bands_of(1)[band]) for k in range(20) for band in (0, 2)] for n in range(4)]
    _, held = run(rocks, tmp_path, zip(batches, (20, 40, 60, 80)), "expires", 1500, wait=2.5)
    assert held[0] > 0 and held[-1] <= held[0] * 2
