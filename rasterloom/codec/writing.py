"""Writing of the second family: analysis, choice of a body by its size, and bytes.

The smallest body is chosen from exact sizes; what ties or near-ties decide is stated
where it is decided. Nothing is written before its size is known.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from rasterloom.codec import bits, blocks, huffman, masks
from rasterloom.codec.model import TYPES, dtype, fail, is_integer, through, type_range
from rasterloom.codec.reading import MAGIC_2, has_mode_byte, takes_huffman

#: Error bounds that a float raster's decimal grid may raise its bound to, with the grid's values a unit.
GRIDS = (
    (0.5, 1), (0.25, 2), (0.05, 10), (0.025, 20), (0.005, 100), (0.0025, 200), (0.0005, 1000), (0.00025, 2000), (0.00005, 10000),
)
#: Distances below the least value at which a float no-data sentinel is tried, besides 4 error bounds.
SENTINEL_STEPS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1e3, 1e4)
LARGEST_BLOCK = 32


@dataclass(frozen=True)
class Options:
    max_z_error: float = 0.0
    micro_block_size: int = 8
    no_data_value: float | None = None
    profile: str = "compact"

    def __post_init__(self):
        if not np.isfinite(self.max_z_error) or self.max_z_error < 0:
            fail("InvalidArgument", "max_z_error must be finite and not negative")
        if not 2 <= self.micro_block_size <= LARGEST_BLOCK:
            fail("InvalidArgument", "micro_block_size must be from 2 to 32")
        if self.no_data_value is not None and not np.isfinite(self.no_data_value):
            fail("InvalidArgument", "no_data_value must be finite")
        if self.profile not in ("compact", "strict"):
            fail("InvalidArgument", "profile must be compact or strict")
        if self.profile == "strict" and (self.micro_block_size != 8 or self.no_data_value is not None):
            fail("InvalidArgument", "the strict profile has blocks of 8 and no no-data value")


@dataclass
class Prepared:
    data_type: str
    values: np.ndarray  # (height, width, depth), sentinel remapped
    valid: np.ndarray
    max_z: float
    requested: float
    micro: int
    low: float = 0.0
    high: float = 0.0
    ranges: tuple[np.ndarray, np.ndarray] | None = None
    original: float | None = None
    encoded: float | None = None
    derived: bool = False
    body: str = "constant"
    version: int = 4
    tiles: tuple | None = None
    body_size: int = 0
    code: tuple | None = None
    mask_encoding: str = "None"
    mask_data: bytes = b""


def raise_to_grid(values: np.ndarray, valid: np.ndarray, max_z: float) -> float:
    """The coarsest of GRIDS above max_z on which all valid values lie, to within half of max_z; else max_z.

    Row by row, grids that fail are dropped; a value that is a whole number of a grid's units isn't
    held against finer grids, whose units divide them.
    """
    open_ = [(e, f) for e, f in GRIDS if e > max_z]
    if max_z <= 0 or not valid.any():
        return max_z
    worst = {f: 0.0 for _, f in open_}
    for row, ok in zip(values, valid):
        part = row[ok].reshape(-1)
        asked = np.ones(len(part), bool)
        for _, f in open_:
            scaled = part * f
            asked &= scaled != through(scaled, "i32")
            if asked.any():
                worst[f] = max(worst[f], float(np.abs(np.floor(scaled[asked] + 0.5) - scaled[asked]).max()))
        open_ = [(e, f) for e, f in open_ if worst[f] / f <= max_z / 2]
        if not open_:
            return max_z
    return open_[0][0]


def choose_sentinel(kind: str, original: float, low: float, high: float, max_z: float) -> tuple[float, float]:
    """(error bound, sentinel as encoded) that no lossy value can be taken for."""
    whole = is_integer(kind)
    if not whole and max_z == 0:
        return max_z, original
    lossless = 0.5 if whole else 0.0
    near = np.floor(max_z) if whole else 2 * max_z
    if low - near <= original <= high + near:
        return lossless, original
    if whole:
        least, most = type_range(kind)
        for bound, at in ((max_z, low - (np.floor(max_z) + 1)), (lossless, low - 1)):
            at = float(through(at, kind))
            if least <= at < low:
                return bound, at
        at = float(through(high + 1, kind))
        return (lossless, at) if high < at <= most and at < original else (lossless, original)
    tried = [low - d for d in (4 * max_z, *SENTINEL_STEPS)] + [low / 2 if low > 0 else low * 2]
    below = float(through(low - 2 * max_z, kind))
    fit = [c for c in map(float, through(np.array(tried), kind)) if np.isfinite(c) and type_range(kind)[0] < c < below]
    if fit:
        return max_z, max(fit)
    return (0.0 if original >= low else max_z), original


def plan_tiles(p: Prepared, micro: int, strict: bool) -> tuple[tuple[list[blocks.Plan], np.ndarray, blocks.Grid], int, int]:
    """((a plan for each dimension, the values they are of, their grid), size, version)."""
    depth = p.values.shape[2]
    grid = blocks.Grid(p.valid, micro)
    values = p.values.reshape(-1, depth)[grid.pixel]
    diffs = depth > 1 and is_integer(p.data_type) and abs(p.max_z - 0.5) < 1e-5 and not strict
    out, version, all_tables = [], 4, np.ones(grid.blocks, bool)
    for d in range(depth):
        own = values[:, d]
        tables = blocks.repeating(own, grid, bool(p.valid.all()), p.max_z) if strict else all_tables
        plan = blocks.plan(own, grid, p.data_type, p.data_type, p.max_z, p.requested, tables)
        if diffs and d:
            delta = own - values[:, d - 1]
            other = blocks.plan(delta, grid, "i32", p.data_type, p.max_z, p.requested, all_tables, diff=True)
            in_range = (other.low >= -(2.0**31)) & (grid.reduce(np.maximum, delta) < 2.0**31)
            use = in_range & (other.form != blocks.NONE) & (other.size < plan.size)
            if use.any():
                plan.take(other, use, grid)
                version = 5
        out.append(plan)
    return (out, values, grid), sum(int(x.size.sum()) for x in out), version


def prepare(values: np.ndarray, data_type: str, mask: np.ndarray | None, options: Options, encoding: str = "Explicit") -> Prepared:
    """All choices for one raster (height, width, depth)."""
    if data_type not in TYPES:
        fail("InvalidArgument", f"unknown sample type {data_type}")
    values = np.asarray(values)
    values = (values if values.ndim == 3 else values[:, :, None]).astype(np.float64)
    h, w, depth = values.shape
    if not values.size:
        fail("InvalidArgument", "an empty raster")
    given = mask is not None
    if given and np.size(mask) != h * w:
        fail("InvalidArgument", "the mask has another size than the raster")
    valid = np.ones((h, w), bool) if mask is None else np.asarray(mask).reshape(h, w) != 0
    if not np.isfinite(values[valid]).all():
        fail("InvalidArgument", "valid samples must be finite")
    no_data, derived, mixed = options.no_data_value, False, np.zeros(values.shape, bool)
    if no_data is not None:
        if depth <= 1:
            fail("InvalidArgument", "a no-data value needs a depth above one")
        if not type_range(data_type)[0] <= no_data <= type_range(data_type)[1]:
            fail("InvalidArgument", "the no-data value is outside the type's range")
        no_data = float(through(no_data, data_type))
        there = values == no_data
        gone = there.all(axis=2) & valid
        if gone.any():
            derived, valid = True, valid & ~gone
        mixed = there & valid[:, :, None]
    max_z = max(float(np.floor(options.max_z_error)), 0.5) if is_integer(data_type) else options.max_z_error
    if no_data is None and not is_integer(data_type):
        max_z = raise_to_grid(values, valid, max_z)
    seen = valid[:, :, None] & ~mixed
    low = np.where(seen, values, np.inf).min(axis=(0, 1))
    high = np.where(seen, values, -np.inf).max(axis=(0, 1))
    original = encoded = None
    if mixed.any():
        original = options.no_data_value
        max_z, encoded = choose_sentinel(data_type, no_data, float(low.min()), float(high.max()), max_z)
        values = np.where(mixed, encoded, values)
        some = mixed.any(axis=(0, 1))
        low, high = np.where(some, np.minimum(low, encoded), low), np.where(some, np.maximum(high, encoded), high)
    p = Prepared(data_type, values, valid, max_z, min(options.max_z_error, max_z), options.micro_block_size, original=original, encoded=encoded, derived=derived)
    p.mask_encoding = encoding if given or derived else "None"
    if valid.any():
        p.low, p.high = float(low.min()), float(high.max())
        if p.low != p.high:
            p.ranges = (low, high)
    _choose_body(p, options, no_data)
    return p


def _choose_body(p: Prepared, options: Options, no_data: float | None) -> None:
    newest = 6 if p.original is not None else 4
    p.version = newest
    if p.ranges is None or (p.ranges[0] == p.ranges[1]).all():
        return
    strict, (h, w, depth) = options.profile == "strict", p.values.shape
    tiles, size, version = plan_tiles(p, p.micro, strict)
    # Symbols exist only where the sentinel, if any was given, is stored as it is.
    found = _huffman(p) if takes_huffman(p.data_type, p.max_z) and p.encoded == no_data else None
    best = found if found and found[0] < size else None
    sweep = int(p.valid.sum()) * depth * dtype(p.data_type).itemsize
    if 2 * p.micro <= LARGEST_BLOCK and 8 * size < 1.5 * h * w * depth and size < 4 * sweep and (not found or size < 2 * found[0]) and max(h, w) > p.micro:
        larger = plan_tiles(p, 2 * p.micro, strict)
        if larger[1] <= (best[0] if best else size):
            (tiles, size, version), best, p.micro = larger, None, 2 * p.micro
    p.version = max(newest, 4 if best else version)
    total = best[0] + 1 if best else size + has_mode_byte(p.data_type, p.max_z, p.version)
    p.body_size = 1 + min(sweep, total)
    if sweep <= total:
        p.body, p.version = "sweep", newest
    elif best:
        p.body, p.code = "huffman", best
    else:
        p.body, p.tiles = "tiles", tiles


def _huffman(p: Prepared):
    """(size, mode, symbols, codes) of the smaller coding; plain on ties."""
    shift = huffman.shift_of(p.data_type)
    plain = (p.values[p.valid] + shift).astype(np.int64).reshape(-1)
    delta = huffman.differences(p.values, p.valid, shift).reshape(-1)
    found = [(c[0], mode, s, c[1]) for mode, s in ((2, plain), (1, delta)) if (c := huffman.candidate(s))]
    return min(found, key=lambda f: (f[0], f[1] == 1)) if found else None


def body_bytes(p: Prepared) -> bytes:
    if p.body == "constant":
        return b""
    if p.body == "sweep":
        return b"\x01" + p.values[p.valid].astype(dtype(p.data_type)).tobytes()
    if p.body == "huffman":
        _, mode, symbols, codes = p.code
        return bytes([0, mode]) + huffman.table_bytes(codes) + huffman.body(symbols, codes)
    plans, values, grid = p.tiles
    return b"\x00" + bytes(has_mode_byte(p.data_type, p.max_z, p.version)) + blocks.written(plans, values, grid, p.data_type, p.version)


def blob(p: Prepared, strict: bool = False, remaining: int = 0) -> bytes:
    h, w, depth = p.values.shape
    mask = masks.payload(p.valid.reshape(-1), p.mask_encoding, strict)
    head = struct.pack("<IIIIiii", h, w, depth, int(p.valid.sum()), p.micro, 0, TYPES.index(p.data_type))
    if p.version >= 6:
        head += struct.pack("<iBBBB", remaining, p.original is not None, 0, 0, 0)
    head += struct.pack("<ddd", p.max_z, p.low, p.high)
    if p.version >= 6:
        head += struct.pack("<dd", p.encoded or 0.0, p.original or 0.0)
    ranges = b"".join(through(r, p.data_type).astype(dtype(p.data_type)).tobytes() for r in p.ranges or ())
    rest = bytearray(head + struct.pack("<I", len(mask)) + mask + ranges + body_bytes(p))
    struct.pack_into("<i", rest, 20, 14 + len(rest))
    return MAGIC_2 + struct.pack("<iI", p.version, bits.fletcher32(rest)) + bytes(rest)


def encode(values: np.ndarray, data_type: str, mask: np.ndarray | None = None, options: Options = Options(), max_bytes: int | None = None) -> bytes:
    """One raster (height, width[, depth]) as a blob; max_bytes bounds it as a buffer would."""
    out = blob(prepare(values, data_type, mask, options), options.profile == "strict")
    if max_bytes is not None and len(out) > max_bytes:
        fail("OutputTooSmall", f"the blob has {len(out)} bytes, {max_bytes} are there")
    return out


def prepare_bands(bands: list[np.ndarray], data_type: str, mask: np.ndarray | None, options: Options) -> list[Prepared]:
    """A shared mask is stored with the first band; if no-data takes pixels out of any band, each stores its own."""
    if not bands:
        fail("InvalidArgument", "a band set is empty")
    if len({np.shape(b) for b in bands}) > 1:
        fail("InvalidArgument", "bands must have one shape")
    found = [prepare(b, data_type, mask, options, "External" if i else "Explicit") for i, b in enumerate(bands)]
    if any(p.derived for p in found):
        for p in found:
            p.mask_encoding = "Explicit"
    return found


def encode_bands(bands: list[np.ndarray], data_type: str, mask: np.ndarray | None = None, options: Options = Options(), max_bytes: int | None = None) -> bytes:
    """Bands of one shape as blobs that follow one another, by the rules of prepare_bands()."""
    found = prepare_bands(bands, data_type, mask, options)
    out = b"".join(blob(p, options.profile == "strict", len(found) - 1 - i) for i, p in enumerate(found))
    if max_bytes is not None and len(out) > max_bytes:
        fail("OutputTooSmall", f"the band set has {len(out)} bytes, {max_bytes} are there")
    return out


def size_of(p: Prepared, strict: bool = False) -> int:
    """The size of blob(p) from its choices, without its bytes."""
    ranges = 2 * p.values.shape[2] * dtype(p.data_type).itemsize if p.ranges else 0
    mask = masks.payload(p.valid.reshape(-1), p.mask_encoding, strict)
    return 14 + 28 + 24 + (24 if p.version >= 6 else 0) + 4 + len(mask) + ranges + p.body_size


def encoded_size(values: np.ndarray, data_type: str, mask: np.ndarray | None = None, options: Options = Options()) -> int:
    """The exact size of encode()'s blob, which isn't made."""
    return size_of(prepare(values, data_type, mask, options), options.profile == "strict")


def encoded_bands_size(bands: list[np.ndarray], data_type: str, mask: np.ndarray | None = None, options: Options = Options()) -> int:
    """The exact size of encode_bands()'s set, which isn't made."""
    return sum(size_of(p, options.profile == "strict") for p in prepare_bands(bands, data_type, mask, options))
