"""The codec against published byte hashes, round trips, and damaged blobs."""

import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.codec import bands, bits, huffman, masks, reading, writing
from rasterloom.codec.model import TYPES, RasterError, dtype, is_integer, through, type_range

Options = writing.Options


def test_bytes_of_the_snapshot_matrix():
    """33 blobs whose bytes a published 64-bit FNV-1a value pins."""
    found = 0xCBF29CE484222325

    def add(blob):
        nonlocal found
        for b in len(blob).to_bytes(8, "little") + blob:
            found = (found ^ b) * 0x100000001B3 % 2**64

    i = np.arange(32)
    values, mask = ((i * 17 + i // 3) % 29).reshape(4, 8), (i % 5 != 0) & (i % 11 != 0)
    for kind in TYPES:
        for e in (0, 1) if is_integer(kind) else (0, 0.25):
            for m in (None, mask):
                add(writing.encode(values, kind, m, Options(e, 4)))
    n = -9999.0
    with_gaps = np.array([10, 20, 30, n, n, n, 11, n, 31, 12, 22, 32]).reshape(2, 2, 3)
    add(writing.encode(with_gaps, "f32", None, Options(0.25, 2, n)))
    assert found == 0x80CEBED2477240E6


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_round_trip_within_the_bound(data):
    kind, depth = data.draw(st.sampled_from(TYPES)), data.draw(st.sampled_from((1, 3)))
    e = data.draw(st.sampled_from((0.0, 0.5, 0.001, 2.0)))
    strict = data.draw(st.booleans())
    rng = np.random.default_rng(data.draw(st.integers(0, 2**32)))
    low, high = (-1e4, 1e4) if not is_integer(kind) else tuple(max(-1e6, min(1e6, x)) for x in type_range(kind))
    spread = data.draw(st.sampled_from((1, 3, 60, high - low)))
    values = through(np.clip(low + rng.random((9, 13, depth)) * spread + (high - low) / 3 * data.draw(st.booleans()), low, high), kind)
    mask = rng.random(117) < data.draw(st.sampled_from((0.0, 0.5, 0.9, 1.0))) if data.draw(st.booleans()) else None
    blob = writing.encode(values, kind, mask, Options(e, 8 if strict else 4, profile="strict" if strict else "compact"))
    info, out, found = reading.decode(blob)
    ok = np.ones((9, 13), bool) if mask is None else mask.reshape(9, 13)
    allowed = 0 if is_integer(kind) and e < 1 else e + (1e-9 if kind == "f64" else np.spacing(np.float32(np.abs(values).max())) if kind == "f32" else 0)
    assert np.abs(out - values)[ok].max(initial=0) <= allowed
    assert (out[~ok] == 0).all() and info.valid_pixel_count == ok.sum() and info.data_type == kind
    assert info.blob_size == len(blob) == writing.encoded_size(values, kind, mask, Options(e, 8 if strict else 4, profile="strict" if strict else "compact"))


@pytest.mark.parametrize("kind", ("u8", "i8"))
@pytest.mark.parametrize("masked", (False, True))
def test_huffman_bodies(kind, masked):
    rng = np.random.default_rng(5)
    steps = rng.choice([0, 0, 0, 0, 1, -1, 2], (40, 50)).cumsum(axis=1).cumsum(axis=0) % 256 - (128 if kind == "i8" else 0)
    mask = rng.random(2000) < 0.7 if masked else None
    p = writing.prepare(steps, kind, mask, Options(0.5))
    assert p.body == "huffman"
    _, out, _ = reading.decode(writing.blob(p))
    ok = np.ones((40, 50), bool) if mask is None else mask.reshape(40, 50)
    assert (out[:, :, 0][ok] == steps[ok]).all()


def test_difference_tiles_need_version_5():
    base = np.random.default_rng(1).integers(0, 60000, (16, 16))
    blob = writing.encode(np.stack([base, base + np.arange(16) % 3], axis=2), "u16", None, Options(0.5))
    info, out, _ = reading.decode(blob)
    assert info.version == 5 and (out[:, :, 1] - out[:, :, 0] == np.arange(16) % 3).all()


def test_no_data_in_all_dimensions_is_masked_and_in_some_is_version_6():
    n = -9999.0
    every = np.array([[[n, n], [1, 2]], [[3, 4], [5, 6]]])
    info, out, mask = reading.decode(writing.encode(every, "f32", None, Options(0.25, 2, n)))
    assert info.version < 6 and not mask[0] and mask[1:].all()
    some = every.copy()
    some[0, 0, 0] = 7
    info, out, mask = reading.decode(writing.encode(some, "f32", None, Options(0.0, 2, n)))
    assert info.version == 6 and info.z_min == info.z_max == -1 and info.min_values is None and info.no_data_value == n
    assert (out == some).all() and mask is None


def test_grid_raise_keeps_the_requested_bound():
    values = np.round(np.random.default_rng(2).random((32, 32)) * 100, 2)
    info, out, _ = reading.decode(writing.encode(values, "f64", None, Options(0.001)))
    assert info.max_z_error == 0.005 and np.abs(out[:, :, 0] - values).max() <= 0.001


def test_integer_bound_of_zero_is_stored_as_a_half():
    assert reading.decode(writing.encode(np.arange(64).reshape(8, 8), "i32"))[0].max_z_error == 0.5


def test_bands_share_a_mask_and_layouts():
    mask = np.array([1, 0, 1, 1])
    data = writing.encode_bands([np.array([[10, 0], [11, 12]]), np.array([[50, 0], [51, 52]])], "u8", mask)
    found = bands.decode_set(data)
    assert [b.info.mask_encoding for b in found] == ["Explicit", "External"] and bands.mask_count(found) == 1
    assert bands.stacked(found).reshape(-1).tolist() == [10, 50, 0, 0, 11, 51, 12, 52]
    assert bands.stacked(found, "bsq").reshape(-1).tolist() == [10, 0, 11, 12, 50, 0, 51, 52]
    assert bands.band_count(data) == 2 and bands.band_count(b"") == 0
    assert bands.band_masks(found).shape == (2, 2, 2)
    second = data[found[1].at :]
    assert bands.blob_info(second).uses_external_mask
    with pytest.raises(RasterError, match="UnsupportedFeature"):
        bands.decode(second)
    assert bands.decode(second, mask).values.reshape(-1).tolist() == [50, 0, 51, 52]
    assert list(bands.frames(io.BytesIO(data))) == [data[: found[1].at], second]
    with pytest.raises(RasterError, match="InvalidArgument"):
        bands.stacked(found, name="i16")
    with pytest.raises(RasterError, match="empty"):
        bands.decode_set(b"")


def test_no_data_out_of_one_band_makes_all_masks_explicit():
    n = -9999
    one = np.array([[[n, n]], [[1, 2]]])
    two = np.array([[[3, 4]], [[5, 6]]])
    data = writing.encode_bands([one, two], "i16", None, Options(0.5, 8, n))
    assert [b.mask is None for b in bands.decode_set(data)] == [False, True]


def _first_family(values, raw=True, mask=None):
    h, w = values.shape
    out = b"CntZImage " + struct.pack("<iiIId", 11, 8, h, w, 0.5)
    if mask is None:
        out += struct.pack("<IIIf", 0, 0, 0, 1.0)
    else:
        runs = masks.write_runs(masks.pack(mask))
        out += struct.pack("<IIIf", 0, 0, len(runs), 1.0) + runs
    ok = np.ones(values.size, bool) if mask is None else mask
    picked = values.reshape(-1)[ok]
    if raw:
        body = b"\x00" + picked.astype("<f4").tobytes()
    else:
        low = picked.min()
        level = (picked - low).astype(np.uint32)
        wide = max(1, int(level.max()).bit_length())
        planes = ((level[:, None] >> np.arange(wide - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1)
        words = np.packbits(np.concatenate((planes, np.zeros(-len(planes) % 32, np.uint8)))).view(">u4").astype("<u4")
        packed, need = words.tobytes(), -(-len(level) * wide // 8)
        if need % 4:
            last = int(words[-1]) >> 8 * (4 - need % 4)
            packed = words[:-1].tobytes() + last.to_bytes(4, "little")[: need % 4]
        body = bytes([1 | 2 << 6, int(low), 2 << 6 | wide, len(level)]) + packed
    return out + struct.pack("<IIIf", 1, 1, len(body), float(picked.max())) + body


@pytest.mark.parametrize("raw", (True, False))
@pytest.mark.parametrize("masked", (True, False))
def test_first_family(raw, masked):
    values = np.arange(7, 42).reshape(5, 7).astype(float)
    mask = np.arange(35) % 4 != 0 if masked else None
    blob = _first_family(values, raw, mask)
    band = bands.decode(blob)
    ok = np.ones((5, 7), bool) if mask is None else mask.reshape(5, 7)
    assert (band.values[:, :, 0] == np.where(ok, values, 0)).all()
    info = bands.inspect_first(blob)
    assert (info.family, info.data_type, info.z_min, info.z_max) == (1, "f32", values[ok].min(), values[ok].max())
    assert bands.inspect_first(blob, compute_range=False).z_min == 0
    assert list(bands.frames(io.BytesIO(blob * 2))) == [blob, blob]


def _damaged(at, data, resum=True):
    out = bytearray(writing.encode(np.arange(64).reshape(8, 8) * 3, "u16"))
    out[at : at + len(data)] = data
    if resum:
        out[10:14] = bits.fletcher32(out[14:]).to_bytes(4, "little")
    return bytes(out)


@pytest.mark.parametrize(
    "blob, kind",
    [
        (b"", "InvalidMagic"), (b"nothing", "InvalidMagic"), (_damaged(6, b"\x09\0\0\0"), "UnsupportedVersion"), (_damaged(14, bytes(4)), "InvalidHeader"),
        (_damaged(22, bytes(4)), "InvalidHeader"), (_damaged(30, bytes(4)), "InvalidHeader"), (_damaged(30, b"\x21\0\0\0"), "InvalidHeader"),
        (_damaged(42, struct.pack("<d", float("nan"))), "InvalidHeader"), (_damaged(50, struct.pack("<dd", 5, 4)), "InvalidHeader"),
        (_damaged(34, struct.pack("<i", 8)), "InvalidHeader"), (_damaged(10, bytes(4), False), "ChecksumMismatch"), (_damaged(0, b"Lerc2 ")[:-1], "Truncated"),
        (_damaged(38, b"\x09\0\0\0"), "InvalidBlob"), (_damaged(26, b"\xff\xff\0\0"), "InvalidBlob"), (_damaged(0, b"Lerc2 ") + b"junk", "InvalidBlob"),
        (_damaged(66, b"\x01\0\0\0"), "InvalidBlob"),
    ],
)
def test_damaged_blobs(blob, kind):
    with pytest.raises(RasterError) as e:
        bands.decode(blob)
    assert e.value.kind == kind


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 6))
def test_any_damage_is_an_error_or_a_raster(seed, n):
    rng = np.random.default_rng(seed)
    blob = bytearray(writing.encode(rng.integers(0, 9, (9, 9, 2)), "u8", rng.random(81) < 0.8, Options(0.5, 4)))
    for at in rng.integers(14, len(blob), n):
        blob[at] = rng.integers(0, 256)
    blob[10:14] = bits.fletcher32(blob[14:]).to_bytes(4, "little")
    try:
        bands.decode(bytes(blob))
    except RasterError:
        pass


@pytest.mark.parametrize(
    "options, kind", [({"max_z_error": -1}, "InvalidArgument"), ({"micro_block_size": 1}, "InvalidArgument"), ({"micro_block_size": 33}, "InvalidArgument"), ({"no_data_value": float("nan")}, "InvalidArgument"), ({"profile": "strict", "micro_block_size": 4}, "InvalidArgument")]
)
def test_options(options, kind):
    with pytest.raises(RasterError) as e:
        Options(**options)
    assert e.value.kind == kind


def test_writer_refuses():
    for args in (([[1.0, np.nan]], "f32"), ([[1, 2]], "u8", None, Options(no_data_value=0.0)), (np.ones((1, 1, 2)), "u8", None, Options(no_data_value=256.0))):
        with pytest.raises(RasterError, match="InvalidArgument"):
            writing.encode(np.array(args[0]), *args[1:])
    with pytest.raises(RasterError, match="OutputTooSmall"):
        writing.encode(np.arange(64).reshape(8, 8), "u8", max_bytes=10)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.booleans())
def test_mask_runs(data, strict):
    runs = (masks.write_strict_runs if strict else masks.write_runs)(data)
    assert masks.read_runs(runs, len(data)) == data


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**31 - 1), min_size=1, max_size=80), st.integers(1, 31))
def test_packing(values, wide):
    values = np.array(values) % 2**wide
    assert (bits.unpack_low(bits.pack_low(values, wide), len(values), wide) == values).all()


def test_mask_of_halves_takes_8_bytes():
    mask = np.arange(256) >= 128
    assert len(masks.payload(mask, "Explicit")) == 8


def test_type_widths():
    assert [dtype(t).itemsize for t in TYPES] == [1, 1, 2, 2, 4, 4, 4, 8]
    assert through(np.array([200.7, -3.9, -500, np.nan]), "i8").tolist() == [127, -3, -128, 0]
    assert huffman.code_lengths(np.array([5])) == {0: (1, 0)}


@pytest.mark.parametrize("kind,e,no_data", (("f32", 0.25, None), ("f32", 0.25, -9999.0), ("u8", 0.5, None), ("i32", 0.5, 7.0)))
@pytest.mark.parametrize("masked", (False, True))
def test_sizes_of_band_sets_without_their_bytes(kind, e, no_data, masked):
    rng = np.random.default_rng(3)
    bands_ = [np.cumsum(rng.integers(0, 3, (21, 34, 2)), axis=1).astype(float) for _ in range(3)]
    if no_data is not None:
        bands_[1][rng.random((21, 34)) < 0.2] = no_data
        bands_[2][rng.random((21, 34, 2)) < 0.2] = no_data
    mask = rng.random(21 * 34) < 0.8 if masked else None
    options = Options(e, 8, no_data)
    assert writing.encoded_bands_size(bands_, kind, mask, options) == len(writing.encode_bands(bands_, kind, mask, options))


@pytest.mark.parametrize("low", (True, False))
@pytest.mark.parametrize("wide", (1, 7, 8, 17, 31))
def test_rows_of_packed_numbers(low, wide):
    rng = np.random.default_rng(wide)
    rows = rng.integers(0, 1 << wide, (5, 13))
    if low:
        packed = bits.pack_rows(rows, wide)
    else:  # most significant bit first, in 32-bit words whose bytes are reversed
        text = ["".join(f"{v:0{wide}b}" for v in row) for row in rows.tolist()]
        words = [[t[i : i + 32].ljust(32, "0") for i in range(0, len(t), 32)] for t in text]
        packed = np.array([[int(w, 2) for w in row] for row in words], "<u4").view(np.uint8)
    assert (bits.unpack_rows(packed, 13, wide, low) == rows).all()
