"""The micro-blocks of a whole raster at once: their forms, sizes and bytes, and reading them.

Blocks are rows of arrays: a step (least value, levels, sizes, packing) is one array operation
over all blocks, or over those of one shape. Only the heads of a blob's blocks are read one by
one, as each tells where the next begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rasterloom.codec import bits
from rasterloom.codec.model import Cursor, bits_required, dtype, fail, is_integer, through

ZERO, RAW, STUFFED, FLAT, NONE = 2, 0, 1, 3, -1


class Grid:
    """The valid pixels of a raster in order of their blocks, row by row in each."""

    def __init__(self, valid: np.ndarray, micro: int):
        h, w = valid.shape
        across = -(-w // micro)
        self.blocks = across * -(-h // micro)
        block = (np.arange(h)[:, None] // micro * across + np.arange(w) // micro)[valid]
        # Short keys are sorted by radix.
        by_block = np.argsort(block.astype(np.uint16) if self.blocks < 1 << 16 else block, kind="stable")
        self.pixel, self.block = np.flatnonzero(valid)[by_block], block[by_block]
        self.n = np.bincount(block, minlength=self.blocks)
        self.start = np.cumsum(self.n) - self.n
        self.check = np.arange(self.blocks) % across * micro >> 3

    def reduce(self, op, values: np.ndarray) -> np.ndarray:
        """op over each block's values; 0 for blocks without valid pixels."""
        out, some = np.zeros(self.blocks, values.dtype), np.flatnonzero(self.n)
        if len(some):
            out[some] = op.reduceat(values, self.start[some])
        return out

    def rows(self, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return values[self.start[of][:, None] + np.arange(n)]


@dataclass
class Plan:
    """Chosen forms of all blocks in one dimension."""

    form: np.ndarray
    size: np.ndarray
    low: np.ndarray
    code: np.ndarray
    bits: np.ndarray
    table: np.ndarray  # distinct levels but zero where a table is chosen, else 0
    diff: np.ndarray
    level: np.ndarray

    def take(self, other: Plan, where: np.ndarray, grid: Grid) -> None:
        for name in ("form", "size", "low", "code", "bits", "table", "diff"):
            setattr(self, name, np.where(where, getattr(other, name), getattr(self, name)))
        self.level = np.where(where[grid.block], other.level, self.level)


def lengths(values: np.ndarray) -> np.ndarray:
    """Bits that whole numbers from 0 need."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0)


def packed_sizes(n: np.ndarray, wide: np.ndarray) -> np.ndarray:
    return (n * wide + 7) // 8


def narrowed(low: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, bytes) of the narrowest types that hold each value."""
    code, size = np.zeros(len(low), np.int64), np.full(len(low), dtype(kind).itemsize)
    for name, number in reversed(bits.NARROWER[kind]):
        fits = through(low, name).astype(np.float64) == low
        code[fits], size[fits] = number, dtype(name).itemsize
    return code, size


def repeating(values: np.ndarray, grid: Grid, all_valid: bool, max_z: float) -> np.ndarray:
    """The strict profile's trigger of tables: over half of a block's values equal the one before
    (zero before the first, if all of the raster is valid)."""
    same = np.zeros(len(values), np.int64)
    same[1:] = (values[1:] == values[:-1]) & (grid.block[1:] == grid.block[:-1])
    first = grid.start[grid.n > 0]
    same[first] = all_valid & (values[first] == 0)
    low, high = grid.reduce(np.minimum, values), grid.reduce(np.maximum, values)
    return (grid.n > 4) & (high > low + 3 * max_z) & (2 * grid.reduce(np.add, same) > grid.n)


def plan(values: np.ndarray, grid: Grid, kind: str, data_type: str, max_z: float, requested: float, tables: np.ndarray, diff: bool = False) -> Plan:
    """The smallest form of each block; raw wins ties, a table must be strictly smaller. Differences
    have no raw form: where nothing else fits, theirs is NONE."""
    n, low, high = grid.n, grid.reduce(np.minimum, values), grid.reduce(np.maximum, values)
    zero = (low == 0) & (high == 0)
    with np.errstate(over="ignore"):
        levels = (high - low) * (1 / (2 * max_z)) if max_z > 0 else np.where(low == high, 0.0, np.inf)
    fits = ~zero & (levels <= (2**15 - 1 if dtype(kind).itemsize < 4 else 2**30 - 1))
    top = np.floor(np.where(fits, levels, 0) + 0.5)
    flat, stuffed = fits & (top == 0) & (high - low <= requested), fits & (top > 0)
    level = np.zeros(len(values), np.int64)
    if stuffed.any():
        some = np.flatnonzero(stuffed[grid.block])
        base, own = low[grid.block[some]], values[some]
        found = np.floor((own - base) * (1 / (2 * max_z)) + 0.5)
        allowed = requested + abs(requested) * 1e-12 + 1e-12
        level[some] = found
        stuffed[grid.block[some[np.abs(base + found * (2 * max_z) - own) > allowed]]] = False
    wide = lengths(grid.reduce(np.maximum, level))
    code, offset = narrowed(low, kind)
    head = 3 + offset + (n > 255)  # of a stuffed block: two heads, the offset, the count
    size = np.where(flat, 1 + offset, head + packed_sizes(n, wide))
    table = np.zeros(grid.blocks, np.int64)
    some = np.flatnonzero((stuffed & tables)[grid.block])
    if len(some):
        keys = np.sort(grid.block[some] << 32 | level[some])
        new = np.append(True, keys[1:] != keys[:-1])
        distinct = np.bincount(keys[new] >> 32, minlength=grid.blocks) - 1
        by_table = head + 1 + packed_sizes(distinct, wide) + packed_sizes(n, lengths(distinct))
        better = (distinct > 0) & (distinct < bits.MAX_TABLE) & (by_table < size) & stuffed
        table, size = np.where(better, distinct, 0), np.where(better, by_table, size)
    form = np.where(flat, FLAT, np.where(stuffed, STUFFED, NONE))
    if not diff:
        raw = 1 + n * dtype(data_type).itemsize
        form = np.where((form == NONE) | (raw <= size), RAW, form)
        size = np.where(form == RAW, raw, size)
    form, size = np.where(zero, ZERO, form), np.where(zero, 1, size)
    return Plan(form, size, low, np.where((form == FLAT) | (form == STUFFED), code, 0), wide, np.where(form == STUFFED, table, 0), np.full(grid.blocks, diff), level)


def _groups(*keys: np.ndarray):
    """Places of rows with equal keys, group by group."""
    if not len(keys[0]):
        return
    order = np.lexsort(keys)
    change = np.zeros(len(order) - 1, bool)
    for key in keys:
        change |= key[order][1:] != key[order][:-1]
    yield from np.split(order, np.flatnonzero(change) + 1)


def _octets(values: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(values.astype(dtype(kind))).view(np.uint8).reshape(len(values), -1)


def _put(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    out[at[:, None] + np.arange(rows.shape[1])] = rows


def written(plans: list[Plan], values: np.ndarray, grid: Grid, data_type: str, version: int) -> bytes:
    """Bytes of all blocks: block by block, in each all dimensions. values: (pixel in order of the grid, dimension)."""
    sizes = np.stack([p.size for p in plans], axis=1)
    at = (np.cumsum(sizes) - sizes.reshape(-1)).reshape(sizes.shape)
    out = np.zeros(int(sizes.sum()), np.uint8)
    check = (grid.check & (15 if version < 5 else 14)) << 2
    for d, p in enumerate(plans):
        here = at[:, d]
        out[here] = p.form | p.diff << 2 | check | p.code << 6
        raw = np.flatnonzero(p.form == RAW)
        for g in _groups(grid.n[raw]):
            of = raw[g]
            _put(out, here[of] + 1, _octets(grid.rows(values[:, d], of, grid.n[of[0]]), data_type))
        body = here + 1
        offsets = np.flatnonzero((p.form == FLAT) | (p.form == STUFFED))
        for g in _groups(p.code[offsets], p.diff[offsets]):
            of = offsets[g]
            own = bits.widened("i32" if p.diff[of[0]] else data_type, int(p.code[of[0]]))
            rows = _octets(through(p.low[of], own), own)
            _put(out, body[of], rows)
            body[of] += rows.shape[1]
        stuffed = np.flatnonzero(p.form == STUFFED)
        for g in _groups(grid.n[stuffed], p.bits[stuffed], p.table[stuffed]):
            of = stuffed[g]
            n, wide, table = int(grid.n[of[0]]), int(p.bits[of[0]]), int(p.table[of[0]])
            code, count = bits.count_code(n)
            fixed = bytes([code << 6 | (32 if table else 0) | wide]) + count + (bytes([table + 1]) if table else b"")
            rows = grid.rows(p.level, of, n)
            if table:
                order = np.argsort(rows, axis=1, kind="stable")
                ranked = np.take_along_axis(rows, order, axis=1)
                new = ranked[:, 1:] != ranked[:, :-1]
                place = np.zeros_like(rows)
                np.put_along_axis(place, order[:, 1:], np.cumsum(new, axis=1), axis=1)
                distinct = ranked[:, 1:][new].reshape(len(of), table)
                packed = np.hstack([bits.pack_rows(distinct, wide), bits.pack_rows(place, bits_required(table))])
            else:
                packed = bits.pack_rows(rows, wide)
            _put(out, body[of], np.frombuffer(fixed, np.uint8)[None].repeat(len(of), 0))
            _put(out, body[of] + len(fixed), packed)
    return out.tobytes()


def read(cur: Cursor, kind: str, version: int, micro: int, max_z: float, tops: np.ndarray, valid: np.ndarray, out: np.ndarray) -> None:
    """Fills out (height, width, depth) from the blocks at cur."""
    grid, depth = Grid(valid, micro), out.shape[2]
    check_mask, step, item = 15 if version < 5 else 14, 2 * max_z, dtype(kind).itemsize
    inner = "i32" if is_integer(kind) else kind  # the type of differences
    data, at, end = cur.data[: cur.end].tobytes(), cur.at, cur.end
    widths: dict[tuple[bool, int], int] = {}
    zeros, raws, flats, stuffed = [], [], [], []

    def short():
        fail("Truncated", f"a block ends behind byte {end}")

    for t, (n, check) in enumerate(zip(grid.n.tolist(), (grid.check & check_mask).tolist())):
        for d in range(depth):
            if at >= end:
                short()
            head = data[at]
            at += 1
            diff, form, code = version >= 5 and bool(head & 4), head & 3, head >> 6
            if head >> 2 & check_mask != check:
                fail("InvalidBlob", "a tile's check code is wrong")
            if diff and d == 0:
                fail("InvalidBlob", "a difference tile in the first dimension")
            if form == ZERO:
                if diff:
                    zeros.append((t, d))
            elif form == RAW:
                if diff:
                    fail("InvalidBlob", "a raw difference tile")
                raws.append((t, d, at))
                at += n * item
            else:
                if (diff, code) not in widths:
                    widths[diff, code] = dtype(bits.widened(inner if diff else kind, code)).itemsize
                offset, at = at, at + widths[diff, code]
                if form == FLAT:
                    flats.append((t, d, diff, code, offset))
                else:
                    if at >= end:
                        short()
                    packed = data[at]
                    width = {0: 4, 1: 2, 2: 1}.get(packed >> 6) or fail("InvalidBlob", "invalid width of a value count")
                    wide, body = packed & 31, at + 1 + width
                    if body > end:
                        short()
                    count = int.from_bytes(data[at + 1 : body], "little")
                    if count > micro * micro:
                        fail("InvalidBlob", f"a block of {count} values is larger than its {micro * micro} places")
                    if packed & 32:
                        if body >= end:
                            short()
                        table, body = data[body], body + 1
                        if not table:
                            fail("InvalidBlob", "an empty lookup table")
                        at = body + bits.packed_size(table - 1, wide) + bits.packed_size(count, bits_required(table - 1))
                    else:
                        table, at = 0, body + bits.packed_size(count, wide)
                    if at > end:
                        short()
                    if count != n:
                        fail("InvalidBlob", "a tile has another number of values than its mask")
                    stuffed.append((t, d, diff, code, offset, body, wide, table))
            if at > end:
                short()
    cur.at = at
    octets, flat = np.frombuffer(data, np.uint8), np.zeros((depth, len(grid.pixel)))
    diffs = np.zeros((depth, grid.blocks), np.int8)  # 1: differences, 2: none
    gather = lambda of, n: octets[of[:, None] + np.arange(n)]

    def fill(of: np.ndarray, rows: np.ndarray) -> None:
        flat[of[:, 1][:, None], grid.start[of[:, 0]][:, None] + np.arange(rows.shape[1])] = rows

    if zeros:
        of = np.array(zeros)
        diffs[of[:, 1], of[:, 0]] = 2
    if raws:
        raws = np.array(raws)
        for g in _groups(grid.n[raws[:, 0]]):
            of = raws[g]
            n = int(grid.n[of[0, 0]])
            fill(of, gather(of[:, 2], n * item).view(dtype(kind)).astype(np.float64))
    for found in filter(len, (flats, stuffed)):
        found = np.array(found)
        offset = np.zeros(len(found))
        for g in _groups(found[:, 3], found[:, 2]):
            own = dtype(bits.widened(inner if found[g[0], 2] else kind, int(found[g[0], 3])))
            offset[g] = gather(found[g, 4], own.itemsize).view(own)[:, 0]
        count = grid.n[found[:, 0]]
        diffs[found[:, 1], found[:, 0]] = found[:, 2]
        for g in _groups(count, *((found[:, 6], found[:, 7]) if found.shape[1] > 5 else ())):
            of, n, base = found[g], int(count[g[0]]), offset[g][:, None]
            top = np.where(of[:, 2] == 1, np.inf, np.asarray(tops)[of[:, 1]])[:, None]
            rows = np.repeat(base, n, axis=1)
            if of.shape[1] > 5 and (of[0, 6] or of[0, 7]):
                wide, table = int(of[0, 6]), int(of[0, 7])
                m = table - 1 if table else n
                used = bits.packed_size(m, wide)
                rows = bits.dequantise(bits.unpack_rows(gather(of[:, 5], used), m, wide, version >= 3).astype(np.float64), base, step, top)
                if table:
                    place_bits = bits_required(table - 1)
                    place = bits.unpack_rows(gather(of[:, 5] + used, bits.packed_size(n, place_bits)), n, place_bits, version >= 3)
                    if place.size and place.max() >= table:
                        fail("InvalidBlob", "an index is outside its lookup table")
                    rows = np.take_along_axis(np.hstack([base, rows]), place, axis=1)
            own = of[:, 2] == 0
            rows[own] = through(rows[own], kind)
            fill(of, rows)
    for d in range(1, depth):
        kinds = diffs[d][grid.block] if diffs[d].any() else ()
        for which in (1, 2) if len(kinds) else ():
            some = np.flatnonzero(kinds == which)
            before = flat[d - 1, some]
            flat[d, some] = through(np.minimum(before + flat[d, some], tops[d]), kind) if which == 1 else before
    out.reshape(-1, depth)[grid.pixel] = flat.T
