"""Reading of both blob families: headers, masks, ranges and samples."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from rasterloom.codec import bits, blocks, huffman, masks
from rasterloom.codec.model import TYPES, BlobInfo, Cursor, check_allocation, dtype, fail, is_integer, through

#: How the two families begin.
MAGIC_1, MAGIC_1_SHORT, MAGIC_2 = b"CntZImage ", b"CntZImage", b"Lerc2 "


def family(data) -> int:
    head = bytes(data[:10])
    if head.startswith(MAGIC_1_SHORT):
        return 1
    return 2 if head.startswith(MAGIC_2) else fail("InvalidMagic", "neither family's magic")


@dataclass
class Parsed:
    info: BlobInfo
    mask_bytes: int = 0
    raw_range: tuple[float, float] = (0.0, 0.0)
    encoded_no_data: float | None = None
    cur: Cursor | None = None
    # Of the first family:
    mask: np.ndarray | None = None
    blocks: list | None = None
    top: float = 0.0


def _finite(*values: float) -> bool:
    return all(map(math.isfinite, values))


def parse_2(data) -> Parsed:
    cur = Cursor(data)
    cur.take(6)
    version = cur.one("<i4")
    if not 1 <= version <= 6:
        fail("UnsupportedVersion", str(version & 0xFFFFFFFF))
    checksum = cur.one("<u4") if version >= 3 else None
    height, width = cur.one("<u4"), cur.one("<u4")
    depth = cur.one("<u4") if version >= 4 else 1
    valid, micro, size, kind = cur.one("<u4"), cur.one("<i4"), cur.one("<i4"), cur.one("<i4")
    more, flag = (cur.one("<i4"), bytes(cur.take(4))) if version >= 6 else (0, bytes(4))
    max_z, low, high = cur.array("<f8", 3).tolist()
    encoded, original = cur.array("<f8", 2).tolist() if version >= 6 else (0.0, 0.0)
    if not width or not height:
        fail("InvalidHeader", "width and height must be above zero")
    if not 1 <= micro <= 32:
        fail("InvalidHeader", "micro-block size must be from 1 to 32")
    if not depth:
        fail("InvalidHeader", "depth must be above zero")
    if not _finite(max_z) or max_z < 0:
        fail("InvalidHeader", "the error bound must be finite and not negative")
    if not _finite(low, high) or low > high:
        fail("InvalidHeader", "the value range must be finite and in order")
    if version >= 6 and (not _finite(encoded, original) or flag[0] > 1 or flag[1] > 1 or flag[0] and depth <= 1 or more < 0):
        fail("InvalidHeader", "invalid no-data fields or band count")
    if size <= 0:
        fail("InvalidHeader", "the blob size must be above zero")
    if size > len(data):
        fail("Truncated", f"the blob has {size} bytes, {len(data)} are there")
    if checksum is not None:
        if size < 14:
            fail("InvalidHeader", "the blob is too small for its checksum")
        if bits.fletcher32(memoryview(data)[14:size]) != checksum:
            fail("ChecksumMismatch", "the checksum does not match")
    if valid > width * height:
        fail("InvalidBlob", "more valid pixels than pixels")
    n = cur.one("<u4")
    encoding = masks.infer(valid, width * height, n)
    if not 0 <= kind < len(TYPES):
        fail("InvalidBlob", f"unknown sample type {kind}")
    no_data = original if flag[0] else None
    shown = (low, high) if no_data is None else (-1.0, -1.0)
    info = BlobInfo(2, version, TYPES[kind], width, height, depth, valid, micro, size, max_z, *shown, encoding, more, no_data_value=no_data)
    cur.end = size
    return Parsed(info, n, (low, high), encoded if flag[0] else None, cur)


def _ranges_2(p: Parsed):
    """Per-depth ranges, and the info that shows them unless no-data hides them."""
    info = p.info
    if info.version < 4 or not info.valid_pixel_count or p.raw_range[0] == p.raw_range[1]:
        return None, info
    check_allocation(info.depth)
    low, high = (p.cur.array(dtype(info.data_type), info.depth).astype(np.float64) for _ in range(2))
    if not np.isfinite([low, high]).all() or (low > high).any():
        fail("InvalidBlob", "a depth range is not finite or not in order")
    if info.no_data_value is None:
        info = replace(info, min_values=tuple(low.tolist()), max_values=tuple(high.tolist()))
    return (low, high), info


def _mask_2(p: Parsed, inherited: np.ndarray | None) -> np.ndarray | None:
    info = p.info
    if info.mask_encoding == "None":
        p.cur.take(p.mask_bytes)
        return None
    check_allocation(info.pixel_count, 1)
    if info.mask_encoding == "ImplicitAllInvalid":
        return np.zeros(info.pixel_count, bool)
    if info.mask_encoding == "External":
        if inherited is None:
            fail("UnsupportedFeature", "the blob needs the mask of another band")
        return masks.check_external(info, inherited)
    mask = masks.unpack(masks.read_runs(p.cur.take(p.mask_bytes), -(-info.pixel_count // 8)), info.pixel_count)
    if int(mask.sum()) != info.valid_pixel_count:
        fail("InvalidBlob", "the mask has another number of valid pixels than the header")
    return mask


def takes_huffman(data_type: str, max_z: float) -> bool:
    return data_type in ("i8", "u8") and abs(max_z - 0.5) < 1e-5


def has_mode_byte(data_type: str, max_z: float, version: int) -> bool:
    return takes_huffman(data_type, max_z) or version >= 6 and not is_integer(data_type) and max_z == 0


def _huffman(cur: Cursor, info: BlobInfo, delta: bool, valid: np.ndarray, out: np.ndarray) -> None:
    shift, n = huffman.shift_of(info.data_type), info.valid_pixel_count
    stream = huffman.Stream(cur, info.version)
    if delta:
        for d in range(info.depth):
            out[:, :, d] = np.where(valid, huffman.restore(stream.symbols(n), valid, shift), 0)
    else:
        out[valid] = (stream.symbols(n * info.depth) - shift).reshape(n, info.depth)


def _decode_2(p: Parsed, inherited: np.ndarray | None):
    mask = _mask_2(p, inherited)
    ranges, info = _ranges_2(p)
    check_allocation(info.sample_count)
    out = np.zeros((info.height, info.width, info.depth))
    valid = np.ones((info.height, info.width), bool) if mask is None else mask.reshape(info.height, info.width)
    cur = p.cur
    uses_all = False
    if not info.valid_pixel_count:
        pass
    elif p.raw_range[0] == p.raw_range[1] and info.no_data_value is None:
        out[valid] = through(np.array(p.raw_range[1]), info.data_type)
    elif info.no_data_value is not None and info.z_min == info.z_max and ranges is None:
        out[valid] = through(np.array(p.raw_range[1]), info.data_type)
    elif ranges is not None and (ranges[0] == ranges[1]).all():
        out[valid] = through(ranges[1], info.data_type)
    elif cur.one("u1"):
        out[valid] = cur.array(dtype(info.data_type), info.valid_pixel_count * info.depth).reshape(-1, info.depth)
    else:
        mode = 0
        if has_mode_byte(info.data_type, info.max_z_error, info.version):
            mode = cur.one("u1")
            if mode > (3 if info.version >= 6 else 2 if info.version >= 4 else 1):
                fail("InvalidBlob", f"invalid encode mode {mode}")
        if mode and not takes_huffman(info.data_type, info.max_z_error):
            fail("UnsupportedFeature", "Huffman coding of floating-point samples")
        if mode:
            _huffman(cur, info, mode == 1, valid, out)
            uses_all = True
        else:
            tops = ranges[1] if ranges is not None else np.full(info.depth, p.raw_range[1])
            blocks.read(cur, info.data_type, info.version, info.micro_block_size, info.max_z_error, tops, valid, out)
    if cur.left and not uses_all:
        fail("InvalidBlob", "bytes behind the samples")
    if info.no_data_value is not None and p.encoded_no_data is not None:
        was, now = (float(through(v, info.data_type)) for v in (p.encoded_no_data, info.no_data_value))
        if was != now:
            out[(out == was) & valid[:, :, None]] = now
    return info, out, mask


def _grid_1(size: int, nominal: int) -> list[tuple[int, int]]:
    """(begin, length) along one side: nominal blocks, and one more for what is left over."""
    base, rest = divmod(size, nominal)
    return [(i * base, base) for i in range(nominal)] + ([(nominal * base, rest)] if rest else [])


def parse_1(data, inherited: np.ndarray | None = None) -> Parsed:
    """With an inherited mask, a mask of the blob's own is taken first, if the blob parses with it."""
    if inherited is not None:
        try:
            return parse_1(data)
        except ValueError:
            pass
    cur = Cursor(data)
    cur.take(len(MAGIC_1))
    version, _ = cur.one("<i4"), cur.one("<i4")
    if version < 0:
        fail("UnsupportedVersion", str(version & 0xFFFFFFFF))
    height, width, max_z = cur.one("<u4"), cur.one("<u4"), cur.one("<f8")
    if not width or not height:
        fail("InvalidHeader", "width and height must be above zero")
    if not _finite(max_z) or max_z < 0:
        fail("InvalidHeader", "the error bound must be finite and not negative")
    check_allocation(width * height, 1)
    if inherited is not None:
        mask, encoding = np.asarray(inherited).reshape(-1) != 0, "External"
        if len(mask) != width * height:
            fail("InvalidBlob", "a shared mask has another size than the raster")
    else:
        by, bx, n, top = *cur.array("<u4", 3).tolist(), cur.one("<f4")
        mask, encoding = None, "None"
        if n:
            mask, encoding = masks.unpack(masks.read_runs(cur.take(n), -(-width * height // 8)), width * height), "Explicit"
        elif by == 0 and bx == 0 and top == 0:
            mask, encoding = np.zeros(width * height, bool), "ImplicitAllInvalid"
    by, bx, n, top = *cur.array("<u4", 3).tolist(), cur.one("<f4")
    if not bx or not by or bx > width or by > height:
        fail("InvalidHeader", "the block grid is empty or larger than the raster")
    if not _finite(top):
        fail("InvalidHeader", "the largest value must be finite")
    pixels = Cursor(cur.take(n))
    valid = np.ones((height, width), bool) if mask is None else mask.reshape(height, width)
    blocks = []
    for y, h in _grid_1(height, by):
        for x, w in _grid_1(width, bx):
            count = int(valid[y : y + h, x : x + w].sum())
            blocks.append((slice(y, y + h), slice(x, x + w), _block_1(pixels, count, max_z, float(top))))
    count = width * height if mask is None else int(mask.sum())
    info = BlobInfo(1, version, "f32", width, height, 1, count, 0, cur.at, max_z, 0.0, float(top), encoding)
    return Parsed(info, mask=mask, blocks=blocks, top=float(top))


def _block_1(cur: Cursor, count: int, max_z: float, top: float) -> np.ndarray:
    """Unrounded values of a block's valid pixels."""
    head = cur.one("u1")
    form = head & 63
    if form > 3:
        fail("InvalidBlob", f"invalid block encoding {form}")
    if form == 2:
        return np.zeros(count)
    if form == 0:
        return cur.array("<f4", count).astype(np.float64)
    kind = {0: "<f4", 1: "<u2", 2: "u1"}.get(head >> 6) or fail("InvalidBlob", "invalid offset type")
    offset = float(cur.array(kind, 1)[0])
    if form == 3:
        return np.full(count, offset)
    packed = cur.one("u1")
    width = {0: "<u4", 1: "<u2", 2: "u1"}.get(packed >> 6) or fail("InvalidBlob", "invalid width of a value count")
    wide = packed & 63
    if cur.one(width) != count:
        fail("InvalidBlob", "a block has another number of values than its mask")
    data = cur.take(bits.packed_size(count, wide))
    if wide > 32:
        fail("InvalidBlob", "too many bits a value")
    return bits.dequantise(bits.unpack_high(data, count, wide).astype(np.float64), offset, 2 * max_z, top)


def _span(values: list[np.ndarray]) -> tuple[float, float] | None:
    some = np.concatenate(values) if values else np.zeros(0)
    some = some[~np.isnan(some)]
    return (float(some.min()), float(some.max())) if len(some) and np.isfinite([some.min(), some.max()]).all() else None


def _decode_1(p: Parsed):
    info = p.info
    check_allocation(info.sample_count)
    out = np.zeros((info.height, info.width, 1))
    valid = np.ones((info.height, info.width), bool) if p.mask is None else p.mask.reshape(info.height, info.width)
    rounded = []
    for ys, xs, values in p.blocks:
        rounded.append(through(values, "f32"))
        out[ys, xs, 0][valid[ys, xs]] = rounded[-1]
    span = _span(rounded)
    return info.with_range(*span) if span else info, out, p.mask


def inspect(data, compute_range: bool = True, inherited: np.ndarray | None = None, want_mask: bool = False):
    """(info, mask or None) without samples. The first family's range needs a scan of its
    blocks, whose values it takes unrounded; with an inherited mask the header's is shown."""
    if family(data) == 1:
        p = parse_1(data, inherited)
        span = _span([v for _, _, v in p.blocks]) if compute_range and inherited is None and p.info.valid_pixel_count else None
        return p.info.with_range(*span) if span else p.info, p.mask
    p = parse_2(data)
    mask = None
    if want_mask or inherited is not None:
        mask = _mask_2(p, inherited)
    else:
        p.cur.take(p.mask_bytes)
    return _ranges_2(p)[1], mask


def decode(data, inherited: np.ndarray | None = None):
    """(info, samples (height, width, depth) as float64, mask or None) of the first blob. Invalid pixels are 0."""
    return _decode_1(parse_1(data, inherited)) if family(data) == 1 else _decode_2(parse_2(data), inherited)
