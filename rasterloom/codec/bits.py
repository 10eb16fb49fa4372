"""Checksums, packed integers, and the quantised blocks made of them."""

from __future__ import annotations

import numpy as np

from rasterloom.codec.model import TYPES, Cursor, bits_required, dtype, fail, is_integer, through

#: A lookup table's length, with the implicit zero, is one byte; so many words of a checksum are added up before it is folded.
MAX_TABLE = 255
WORDS_A_FOLD = 359


def fletcher32(data) -> int:
    """Sums of big-endian 16-bit words, folded after every 359 of them and at the end."""
    raw = np.frombuffer(data, np.uint8)
    words = raw[: len(raw) // 2 * 2].reshape(-1, 2).astype(np.int64)
    words = words[:, 0] << 8 | words[:, 1]
    fold = lambda s: (s & 0xFFFF) + (s >> 16)
    first = second = 0xFFFF
    whole = len(words) // WORDS_A_FOLD * WORDS_A_FOLD
    parts = words[:whole].reshape(-1, WORDS_A_FOLD)
    sums = [(WORDS_A_FOLD, *pair) for pair in zip(parts.sum(axis=1).tolist(), (parts @ np.arange(WORDS_A_FOLD, 0, -1)).tolist())]
    if rest := len(words) - whole:
        sums.append((rest, int(words[whole:].sum()), int(words[whole:] @ np.arange(rest, 0, -1))))
    for n, plain, weighted in sums:
        second = fold(second + n * first + weighted)
        first = fold(first + plain)
    if len(raw) % 2:
        first += int(raw[-1]) << 8
        second += first
    return fold(second) << 16 & 0xFFFFFFFF | fold(first) & 0xFFFF


def pack_rows(rows: np.ndarray, bits: int) -> np.ndarray:
    """Each row's numbers, least significant bits first, as a row of bytes."""
    planes = (rows.astype(np.uint32)[:, :, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(planes.reshape(len(rows), -1), axis=1, bitorder="little")


def pack_low(values: np.ndarray, bits: int) -> bytes:
    """Least significant bits first."""
    return pack_rows(np.asarray(values)[None], bits).tobytes()


def unpack_rows(rows: np.ndarray, n: int, bits: int, low: bool = True) -> np.ndarray:
    """n numbers from each row of bytes: least significant bits first, or else most significant bits of
    32-bit words first; a last word that is cut short holds its top bytes."""
    if not bits or not n:
        return np.zeros((len(rows), n), np.int64)
    if not low:
        missing = -rows.shape[1] % 4
        words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, missing)))).view("<u4")
        words[:, -1] <<= np.uint32(8 * missing)
        rows = words.astype(">u4").view(np.uint8)
    planes = np.unpackbits(rows, axis=1, count=n * bits, bitorder="little" if low else "big").reshape(len(rows), n, bits)
    weights = 2.0 ** np.arange(bits)  # sums stay below 2**53, so floats are exact
    return (planes.astype(np.float64) @ (weights if low else weights[::-1])).astype(np.int64)


def unpack_low(data, n: int, bits: int) -> np.ndarray:
    return unpack_rows(np.frombuffer(data, np.uint8)[None], n, bits)[0]


def unpack_high(data, n: int, bits: int) -> np.ndarray:
    return unpack_rows(np.frombuffer(data, np.uint8)[None], n, bits, False)[0]


def packed_size(n: int, bits: int) -> int:
    return -(-n * bits // 8)


def dequantise(n: np.ndarray, offset: float, step: float, top: float) -> np.ndarray:
    """offset + n * step; from the level that reaches top on, top. offset and top: numbers, or a column of them."""
    if step == 0:
        return offset + n * step
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(n < np.ceil((top - offset) / step), offset + n * step, top)


def read_stuffed(cur: Cursor, version: int, limit: int, offset: float | None, step: float, top: float) -> np.ndarray:
    """Values of a bit-stuffed block; without an offset, its bare integers."""
    head = cur.one("u1")
    width = {0: "<u4", 1: "<u2", 2: "u1"}.get(head >> 6) or fail("InvalidBlob", "invalid width of a value count")
    bits, n = head & 31, cur.one(width)
    if n > limit:
        fail("InvalidBlob", f"a block of {n} values is larger than its {limit} places")
    unpack = unpack_low if version >= 3 else unpack_high
    scaled = (lambda v: v.astype(np.float64)) if offset is None else (lambda v: dequantise(v.astype(np.float64), offset, step, top))
    if not head & 32:
        if not bits:
            return np.full(n, offset or 0.0)
        return scaled(unpack(cur.take(packed_size(n, bits)), n, bits))
    if offset is None:
        fail("InvalidBlob", "a block with a lookup table has no offset")
    size = cur.one("u1")
    if not size:
        fail("InvalidBlob", "an empty lookup table")
    table = np.concatenate(([offset], scaled(unpack(cur.take(packed_size(size - 1, bits)), size - 1, bits))))
    wide = bits_required(size - 1)
    at = unpack(cur.take(packed_size(n, wide)), n, wide)
    if n and at.max() >= size:
        fail("InvalidBlob", "an index is outside its lookup table")
    return table[at]


def count_code(n: int) -> tuple[int, bytes]:
    for code, kind in ((2, "u1"), (1, "<u2"), (0, "<u4")):
        if n <= np.iinfo(kind).max:
            return code, np.array([n], kind).tobytes()
    return fail("SizeOverflow", "value count")


def stuffed(values: np.ndarray) -> bytes:
    """Integers, each with as many bits as the largest needs."""
    bits = bits_required(values.max(initial=0))
    code, n = count_code(len(values))
    return bytes([code << 6 | bits]) + n + (pack_low(values, bits) if bits else b"")


def tabled(values: np.ndarray) -> bytes | None:
    """The same by a lookup table of the distinct values but zero, or None where none is allowed."""
    levels, at = np.unique(values, return_inverse=True)
    size = len(levels) - 1
    if not 0 < size < MAX_TABLE:
        return None
    bits = bits_required(levels[-1])
    code, n = count_code(len(values))
    return bytes([code << 6 | 32 | bits]) + n + bytes([size + 1]) + pack_low(levels[1:], bits) + pack_low(at.reshape(-1), bits_required(size))


#: For each type, the narrower types of a block's offset, narrowest first, with their codes.
NARROWER = {
    "i8": (), "u8": (), "i16": (("i8", 2), ("u8", 1)), "u16": (("u8", 1),),
    "i32": (("u8", 3), ("i16", 2), ("u16", 1)), "u32": (("u8", 2), ("u16", 1)),
    "f32": (("u8", 2), ("i16", 1)), "f64": (("i16", 3), ("i32", 2), ("f32", 1)),
}


def narrow(value: float, kind: str) -> tuple[int, str]:
    """(code, type): the narrowest type that holds the value exactly."""
    for name, code in NARROWER[kind]:
        if float(through(value, name)) == value:
            return code, name
    return 0, kind


def widened(kind: str, code: int) -> str:
    """The offset type that a code stands for. Floats take any higher code as their narrowest."""
    if kind in ("i8", "u8") or code == 0:
        return kind
    names = {c: n for n, c in NARROWER[kind]}
    if kind == "f32" and code > 2:
        return "u8"
    if code in names:
        return names[code]
    # Codes that no writer uses still name a type where counting down from this one reaches it.
    at = TYPES.index(kind) - code * (2 if kind in ("u16", "u32") else 1)
    return TYPES[at] if 0 <= at and is_integer(kind) else fail("InvalidBlob", f"offset code {code} of {kind}")


def scalar(value: float, kind: str) -> bytes:
    return through(value, kind).astype(dtype(kind)).tobytes()
