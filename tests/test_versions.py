"""Blobs of the early versions, made by hand, and damage to each part of a blob."""

import struct

import numpy as np
import pytest

from rasterloom.codec import bands, bits, masks, writing
from rasterloom.codec.model import TYPES, RasterError, dtype

SWEEP, TILES, STUFFED, TABLE = b"\x01", b"\x00", 1, 32


def second_family(version, kind, shape, body, low, high, max_z=0.5, mask=None, runs=None, valid=None, micro=8):
    """A blob of version 1, 2, 3 or 4; runs: mask bytes instead of those of the mask."""
    if runs is None:
        runs = b"" if mask is None or not mask.any() else masks.write_runs(masks.pack(mask))
    if valid is None:
        valid = shape[0] * shape[1] if mask is None else int(mask.sum())
    head = struct.pack("<II", *shape) + (struct.pack("<I", 1) if version >= 4 else b"")
    size = 10 + 4 * (version >= 3) + len(head) + 16 + 24 + 4 + len(runs) + len(body)
    rest = head + struct.pack("<Iiii", valid, micro, size, TYPES.index(kind)) + struct.pack("<ddd", max_z, low, high) + struct.pack("<I", len(runs)) + runs + body
    check = struct.pack("<I", bits.fletcher32(rest)) if version >= 3 else b""
    return b"Lerc2 " + struct.pack("<i", version) + check + rest


def packed(numbers, wide, high_first):
    """Numbers as bits: the lowest first, or the highest first in little-endian words without unused low bytes."""
    if not high_first:
        return bits.pack_low(np.array(numbers), wide)
    text = "".join(f"{n:0{wide}b}" for n in numbers)
    need = -(-len(text) // 8)
    words = [int(text[i : i + 32].ljust(32, "0"), 2) for i in range(0, len(text), 32)]
    out = b"".join(w.to_bytes(4, "little") for w in words[:-1])
    left = need - len(out)
    return out + (words[-1] >> 8 * (4 - left)).to_bytes(left, "little")


def tile(values, check, high_first, table=False):
    """A block of u16 with its least value as offset."""
    low = int(min(values))
    level = [int(v) - low for v in values]
    out = bytes([STUFFED | check << 2]) + struct.pack("<H", low)
    if not table:
        wide = max(level).bit_length()
        return out + bytes([2 << 6 | wide, len(level)]) + packed(level, wide, high_first)
    known = sorted(set(level))
    wide = known[-1].bit_length()
    places = [known.index(n) for n in level]
    return out + bytes([2 << 6 | TABLE | wide, len(level), len(known)]) + packed(known[1:], wide, high_first) + packed(places, (len(known) - 1).bit_length(), high_first)


@pytest.mark.parametrize("version", (1, 2, 3))
@pytest.mark.parametrize("masked", (False, True))
@pytest.mark.parametrize("table", (False, True))
def test_early_versions_of_tiles(version, masked, table):
    """Below version 3 there is no checksum, and packed numbers have their highest bit first."""
    values = (np.arange(54).reshape(6, 9) % 7 * 31 + 100).astype(float)
    mask = np.arange(54) % 5 != 0 if masked else np.ones(54, bool)
    ok = mask.reshape(6, 9)
    body = TILES + b"".join(tile(values[:, x][ok[:, x]], check, version < 3, table) for check, x in ((0, slice(0, 8)), (1, slice(8, 9))))
    blob = second_family(version, "u16", (6, 9), body, values[ok].min(), values[ok].max(), mask=mask if masked else None)
    found = bands.decode(blob)
    assert (found.values[:, :, 0] == np.where(ok, values, 0)).all()
    info = bands.blob_info(blob)
    assert (info.version, info.depth, info.valid_pixel_count, info.data_type, info.min_values) == (version, 1, int(mask.sum()), "u16", None)


@pytest.mark.parametrize("version", (1, 2, 3))
@pytest.mark.parametrize("kind", TYPES)
def test_early_versions_of_sweeps_constants_and_nothing(version, kind):
    values = np.arange(12).reshape(3, 4)
    sweep = second_family(version, kind, (3, 4), SWEEP + values.astype(dtype(kind)).tobytes(), 0, 11, 0.25)
    assert (bands.decode(sweep).values[:, :, 0] == values).all()
    constant = second_family(version, kind, (3, 4), b"", 5, 5)
    assert (bands.decode(constant).values == 5).all()
    nothing = second_family(version, kind, (3, 4), b"", 0, 0, mask=np.zeros(12, bool))
    assert not bands.decode(nothing).mask.any() and bands.blob_info(nothing).mask_encoding == "ImplicitAllInvalid"
    two = bands.decode_set(sweep + constant)
    assert [b.info.version for b in two] == [version] * 2 and bands.band_count(sweep + constant) == 2


HALF = np.arange(12) % 2 == 0
RUNS = masks.write_runs(masks.pack(HALF))
FLAT = dict(version=3, kind="u16", shape=(3, 4), body=b"", low=5, high=5)
BLOCK = tile([1, 9, 4, 7] * 3, 0, False)


@pytest.mark.parametrize(
    "change, kind",
    [
        ({"body": b"\0"}, "InvalidBlob"),  # bytes behind a constant
        ({"mask": np.zeros(12, bool), "body": b"\0"}, "InvalidBlob"),  # and behind nothing
        ({"runs": RUNS, "valid": 5}, "InvalidBlob"),  # the mask has 6 pixels
        ({"runs": RUNS + b"\0", "valid": 6}, "InvalidBlob"),  # a byte behind the runs' end
        ({"runs": RUNS[:-1], "valid": 6}, "InvalidBlob"),
        ({"runs": RUNS, "valid": 12}, "InvalidBlob"),  # mask bytes though all pixels are valid
        ({"runs": RUNS, "valid": 0}, "InvalidBlob"),  # or none is
        ({"valid": 6}, "UnsupportedFeature"),  # a mask that no band hands on
        ({"shape": (0, 4)}, "InvalidHeader"), ({"shape": (3, 0)}, "InvalidHeader"),
        ({"micro": 33}, "InvalidHeader"), ({"micro": 0}, "InvalidHeader"),
        ({"max_z": float("inf")}, "InvalidHeader"), ({"max_z": -0.5}, "InvalidHeader"),
        ({"low": float("nan")}, "InvalidHeader"), ({"low": 6}, "InvalidHeader"),
        ({"low": 1, "high": 9, "body": TILES + BLOCK[:-1]}, "Truncated"),  # packed numbers end early
        ({"low": 1, "high": 9, "body": TILES + bytes([BLOCK[0] | 4]) + BLOCK[1:]}, "InvalidBlob"),  # check code
        ({"low": 1, "high": 9, "body": TILES + BLOCK[:3] + b"\xc4" + BLOCK[4:]}, "InvalidBlob"),  # width of the count
        ({"low": 1, "high": 9, "body": TILES + BLOCK[:4] + b"\x0b" + BLOCK[5:]}, "InvalidBlob"),  # 11 values for 12 places
        ({"low": 1, "high": 9, "body": TILES + BLOCK[:3] + bytes([BLOCK[3] | TABLE, 12, 0]) + BLOCK[5:]}, "InvalidBlob"),  # empty table
        ({"low": 1, "high": 9, "body": SWEEP + bytes(23)}, "Truncated"),
        ({"low": 1, "high": 9, "body": SWEEP + bytes(25)}, "InvalidBlob"),
        ({"kind": "u8", "low": 1, "high": 9, "body": TILES + b"\x07" + bytes(40)}, "InvalidBlob"),  # coding mode
        ({"kind": "u8", "low": 1, "high": 9, "body": TILES + b"\x01" + bytes(40)}, None),  # table of no codes
    ],
)
def test_damage_in_each_part(change, kind):
    with pytest.raises(RasterError) as e:
        bands.decode(second_family(**FLAT | change))
    assert kind is None or e.value.kind == kind


def test_allocations_are_checked_before_they_are_made():
    for change in ({"shape": (2**31, 2**31 - 1), "valid": 1, "runs": RUNS}, {"shape": (2**16, 2**16), "valid": 2**32 - 1, "runs": RUNS}):
        with pytest.raises(RasterError):
            bands.decode(second_family(**FLAT | change))
    with pytest.raises(RasterError):
        bands.decode(second_family(**FLAT | {"shape": (2**16, 2**15), "version": 4}))


def test_sets_that_do_not_fit_together():
    flat = second_family(**FLAT)
    for other in (second_family(**FLAT | {"shape": (4, 3)}), second_family(**FLAT | {"kind": "i16"}), b"junk", flat[:-1]):
        for read in (bands.band_count, bands.decode_set):
            with pytest.raises(RasterError):
                read(flat + other)
    for read in (bands.decode, bands.blob_info):  # one blob's reader takes no set
        with pytest.raises(RasterError, match="InvalidBlob"):
            read(flat * 2)
    assert bands.decode_first(flat * 2).values.shape == (3, 4, 1) and bands.band_count(b"") == 0
    with pytest.raises(RasterError):
        bands.decode_set(b"")
    late = writing.encode_bands([np.ones((2, 2, 2)) * [1, 9]] * 2, "u8", None, writing.Options(0.5, 8, 9.0))
    first = late[: bands.inspect_first(late).blob_size]
    assert bands.band_count(late) == 2
    if bands.inspect_first(late).version == 6:  # the first tells of one more band
        with pytest.raises(RasterError, match="InvalidBlob"):
            bands.band_count(first)


def first_family(shape=(2, 2), grid=(1, 1), body=b"\x00" + bytes(16), top=1.0, version=11, max_z=0.5, size=None):
    out = b"CntZImage " + struct.pack("<iiIId", version, 8, *shape, max_z) + struct.pack("<IIIf", 0, 0, 0, 1.0)
    return out + struct.pack("<IIIf", *grid, len(body) if size is None else size, top) + body


@pytest.mark.parametrize(
    "change, kind",
    [
        ({"shape": (0, 2)}, "InvalidHeader"), ({"grid": (0, 1)}, "InvalidHeader"), ({"grid": (1, 3)}, "InvalidHeader"),
        ({"top": float("nan")}, "InvalidHeader"), ({"max_z": float("nan")}, "InvalidHeader"), ({"version": -1}, "UnsupportedVersion"),
        ({"size": 40}, "Truncated"), ({"body": b"\x00" + bytes(15)}, "Truncated"),
        ({"body": bytes([1 | 2 << 6, 0, 2 << 6 | 1, 3, 0])}, "InvalidBlob"),  # 3 values for 4 places
    ],
)
def test_damage_in_the_first_family(change, kind):
    assert bands.decode(first_family()).values.shape == (2, 2, 1)
    with pytest.raises(RasterError) as e:
        bands.decode(first_family(**change))
    assert e.value.kind == kind


@pytest.mark.parametrize("e", (0.001, 0.01, 0.25, 3.0))
@pytest.mark.parametrize("kind", ("f32", "f64", "i32", "u16"))
def test_hard_values_stay_within_the_bound(e, kind):
    """Values beside the edges of levels, and of very different sizes."""
    step = 2 * e
    values = np.array([k * step / 2 + s * step * 1e-6 for k in range(60) for s in (-1, 0, 1)] + [0.0, 1e4, 30000.3, 12345.678] * 3)
    values = np.clip(values, 0, None) if kind == "u16" else values
    values = values.astype(dtype(kind)).reshape(12, -1)
    found = bands.decode(writing.encode(values.astype(float), kind, None, writing.Options(e))).values[:, :, 0]
    assert np.abs(found - values.astype(float)).max() <= e * (1 + 1e-9) + (np.spacing(np.float32(30000)) / 2 if kind == "f32" else 0)
