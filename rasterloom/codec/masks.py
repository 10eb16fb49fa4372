"""Validity masks: a bit for each pixel, most significant first, run-length coded."""

from __future__ import annotations

import numpy as np

from rasterloom.codec.model import BlobInfo, fail

#: The longest run, and the mark behind the last.
LONGEST, STOP = 32767, -32768
#: A run becomes a repeat from so many bytes on: alone, at one end of the mask (or behind a repeat), or between literals.
ALONE, AT_AN_END, BETWEEN = 2, 4, 6


def infer(valid: int, pixels: int, n_bytes: int) -> str:
    if valid in (0, pixels):
        if n_bytes:
            fail("InvalidBlob", "mask bytes in a blob whose pixels are all valid or all invalid")
        return "None" if valid == pixels else "ImplicitAllInvalid"
    return "Explicit" if n_bytes else "External"


def unpack(bitset: bytes, pixels: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitset, np.uint8), count=pixels).astype(bool)


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(np.asarray(mask).reshape(-1) != 0).tobytes()


def read_runs(data, n: int) -> bytes:
    """n bytes of run-length coding that ends with its sentinel and has nothing behind it."""
    data, at, out = bytes(data), 0, bytearray()
    while True:
        if at + 2 > len(data):
            fail("InvalidBlob", "mask runs end early")
        count = int.from_bytes(data[at : at + 2], "little", signed=True)
        at += 2
        if count == STOP:
            break
        size = count if count > 0 else 1
        if at + size > len(data) or len(out) + abs(count) > n:
            fail("InvalidBlob", "a mask run is too long")
        out += data[at : at + size] if count > 0 else data[at : at + 1] * -count
        at += size
    if len(out) != n or at != len(data):
        fail("InvalidBlob", "mask runs do not fill the mask, or have bytes behind them")
    return bytes(out)


def _literal(part: bytes) -> bytes:
    return b"".join(len(c).to_bytes(2, "little") + c for c in (part[i : i + LONGEST] for i in range(0, len(part), LONGEST)))


def _repeat(value: int, n: int) -> bytes:
    counts = [LONGEST] * (n // LONGEST) + [n % LONGEST] * (n % LONGEST > 0)
    return b"".join((-c).to_bytes(2, "little", signed=True) + bytes([value]) for c in counts)


def write_runs(bitset: bytes) -> bytes:
    """Literals and repeats, a repeat where it is no longer than the literal that it splits."""
    raw = np.frombuffer(bitset, np.uint8)
    begins = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1]))) if len(raw) else np.zeros(0, int)
    out, pending = [], 0
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(raw)]):
        ends = (a == pending) + (b == len(raw))
        if b - a >= (BETWEEN, AT_AN_END, ALONE)[ends]:
            out += [_literal(bitset[pending:a]), _repeat(bitset[a], b - a)]
            pending = b
    return b"".join([*out, _literal(bitset[pending:]), STOP.to_bytes(2, "little", signed=True)])


#: Fixed value: the strict profile opens a repeat at so many equal bytes, but never at the last byte of the mask.
STRICT_REPEAT = 5


def write_strict_runs(bitset: bytes) -> bytes:
    """The runs of the strict profile: greedy, a repeat for five equal bytes or more that don't end the mask.

    A byte that follows a repeat opens a literal; both kinds are split at 32767 bytes.
    """
    out, n = [], len(bitset)
    raw = np.frombuffer(bitset, np.uint8)
    begins = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1]))) if n else np.zeros(0, int)
    pending = 0
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), n]):
        if b - a > STRICT_REPEAT or b - a == STRICT_REPEAT and b < n:
            out += [_literal(bitset[pending:a]), _repeat(bitset[a], b - a)]
            pending = b
    return b"".join([*out, _literal(bitset[pending:]), STOP.to_bytes(2, "little", signed=True)])


def payload(mask: np.ndarray | None, encoding: str, strict: bool = False) -> bytes:
    """What a blob carries of its mask: nothing if it is uniform or another band's."""
    if mask is None or encoding != "Explicit" or mask.all() or not mask.any():
        return b""
    return (write_strict_runs if strict else write_runs)(pack(mask))


def check_external(info: BlobInfo, mask: np.ndarray) -> np.ndarray:
    mask = np.asarray(mask).reshape(-1) != 0
    if len(mask) != info.pixel_count:
        fail("InvalidBlob", "an inherited mask has another size than the raster")
    if int(mask.sum()) != info.valid_pixel_count:
        fail("InvalidBlob", "an inherited mask has another number of valid pixels than the raster")
    return mask
