"""Headers as expressions against the codec's own reading."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.codec import writing
from rasterloom.codec.model import TYPES
from rasterloom.functions import blobs, headers
from rasterloom.plans import queries
from tests.test_versions import FLAT, second_family

SF = "/root/testdata/sf0.001"


def blob_kinds():
    """Blobs of all versions and types, with masks, depth, bands and no-data."""
    rng = np.random.default_rng(3)
    made = [second_family(v, k, (3, 4), b"\x01" + np.arange(12).astype(writing.dtype(k)).tobytes(), 0, 11, 0.25) for v in (1, 2, 3) for k in TYPES]
    for kind in TYPES:
        values = rng.integers(0, 100, (9, 11, 3)).astype(float)
        made += [writing.encode(values, kind), writing.encode(values - (kind[0] != "u") * 50, kind, rng.random((9, 11)) < 0.5, writing.Options(0.5))]
        values[rng.random(values.shape) < 0.2] = 99
        made.append(writing.encode(values, kind, None, writing.Options(0.5, 8, 99.0)))
    made += [writing.encode(np.array([[x, y]]), "f64") for x, y in ((5e-324, 1e-310), (-1.7976931348623157e308, 1.7e308), (-0.1, 0.1), (math.pi, -math.e))]
    made += [writing.encode(np.array([[x, y]]), "f32") for x, y in ((1e-45, 1e-39), (-3.4e38, 3.4e38), (0.1, 0.2))]
    made += [writing.encode(np.zeros((4, 4)), "u8", np.zeros((4, 4))), writing.encode(np.full((4, 4), 7), "i8"), writing.encode_bands([np.ones((2, 2)), np.eye(2)], "u16", np.array([1, 0, 1, 1]))]
    return made


def damaged():
    sound = second_family(**FLAT)
    made = [b"", b"Lerc2", b"Lerc2 ", b"junk junk junk", sound[:40], sound[:-1], sound[:60], b"Lerc2 " + struct.pack("<i", 7) + sound[10:], b"Lerc2 " + struct.pack("<i", -1) + sound[10:]]
    made.append(sound[:12] + bytes([sound[12] ^ 1]) + sound[13:])
    for change in ({"shape": (0, 2)}, {"micro": 0}, {"micro": 33}, {"max_z": -1.0}, {"max_z": float("nan")}, {"low": 6}, {"high": float("inf")}, {"valid": 13}, {"runs": b"\0\0"}, {"valid": 0, "runs": b"\0\0"}):
        made.append(second_family(**FLAT | change))
    six = writing.encode(np.array([[[1, 9], [9, 2]]]), "u8", None, writing.Options(0.5, 8, 9.0))
    put = lambda at, raw: six[:at] + raw + six[at + len(raw) :]
    made += [put(46, b"\2"), put(22, struct.pack("<I", 1)), put(74, struct.pack("<d", float("nan"))), put(42, struct.pack("<i", -1)), put(34, struct.pack("<i", 0)), put(34, struct.pack("<i", 10**6)), put(38, struct.pack("<i", 8))]
    return made


@pytest.fixture(scope="module")
def read(spark):
    def run(made, **options):
        rows = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate(made)], "k int, content binary")
        found = rows.select("k", headers.header(F.col("content"), **options).alias("h"), blobs.inspect(F.col("content")).alias("i"))
        return [(r.h.asDict(), r.i.asDict()) for r in found.orderBy("k").collect()]

    return run


def test_all_fields_are_the_codec_s(read):
    for got, want in read(blob_kinds(), verify=True):
        assert want["error_kind"] is None and got == {n: v for n, v in want.items() if n != "error_message"}


def test_errors_are_the_codec_s(read):
    made = damaged()
    for blob, (got, want) in zip(made, read(made, verify=True)):
        assert got["error_kind"] == want["error_kind"] or (len(blob) < 10 and {got["error_kind"], want["error_kind"]} <= {"InvalidMagic", "Truncated", "UnsupportedVersion"}), (blob, got["error_kind"], want["error_kind"])
        assert all(v is None for n, v in got.items() if n != "error_kind")
    assert {w["error_kind"] for _, w in read(made)} >= {"InvalidHeader", "InvalidBlob", "Truncated", "ChecksumMismatch", "UnsupportedVersion", "InvalidMagic"}


def test_null_and_first_family(read):
    old = b"CntZImage " + bytes(80)
    (a, _), (b, _) = read([None, old])
    assert all(v is None for v in a.values()) and b["error_kind"] == "UnsupportedFeature" and b["width"] is None


def test_filters_run_below_decoding(spark):
    plan = queries.header_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("conv(") and "ArrowEvalPython" not in plan
    rows = spark.createDataFrame([(1, bytearray(blob_kinds()[30]))], "k int, content binary")
    plan = rows.where(headers.header(F.col("content"))["width"] > 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
