"""Blobs that follow one another: bands of one raster, with masks handed on, and layouts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from rasterloom.codec import reading
from rasterloom.codec.model import BlobInfo, dtype, fail, through


@dataclass
class Band:
    info: BlobInfo
    values: np.ndarray  # (height, width, depth), float64
    mask: np.ndarray | None  # flat, or None if all pixels are valid
    at: int


def each(data, inherited: np.ndarray | None = None, samples: bool = True) -> Iterator[Band]:
    """Each band in turn. A band takes over its predecessor's mask if it has none of its own but
    fewer valid pixels than pixels; a band without a mask, or of the other family, ends that."""
    at, carried, last = 0, inherited, None
    while at < len(data):
        rest = memoryview(data)[at:]
        family = reading.family(rest)
        if last not in (None, family):
            carried = None
        if samples:
            info, values, mask = reading.decode(rest, carried)
        else:
            (info, mask), values = reading.inspect(rest, True, carried, want_mask=family == 2), np.zeros((0, 0, 0))
        yield Band(info, values, mask, at)
        carried, last = mask, family
        if info.blob_size <= 0 or at + info.blob_size > len(data):
            fail("InvalidBlob", "a blob does not advance, or runs past the end")
        at += info.blob_size


def check(bands: list[BlobInfo]) -> list[BlobInfo]:
    """Bands of one set have one shape and type; version 6 counts the bands that follow."""
    if not bands:
        fail("InvalidBlob", "band set is empty")
    if len({(b.width, b.height, b.depth, b.data_type) for b in bands}) > 1:
        fail("InvalidBlob", "bands differ in shape or type")
    for i, b in enumerate(bands):
        if b.family == 2 and b.version >= 6 and b.remaining_band_count != len(bands) - 1 - i:
            fail("InvalidBlob", f"band {i} tells of {b.remaining_band_count} more bands, {len(bands) - 1 - i} follow")
    return bands


def strict(data, info: BlobInfo) -> BlobInfo:
    if info.blob_size != len(data):
        fail("InvalidBlob", f"{len(data) - info.blob_size} bytes behind the blob")
    return info


def inspect_first(data, compute_range: bool = True, mask: np.ndarray | None = None) -> BlobInfo:
    return reading.inspect(data, compute_range, mask)[0]


def blob_info(data, mask: np.ndarray | None = None) -> BlobInfo:
    return strict(data, inspect_first(data, True, mask))


def band_count(data) -> int:
    """The number of bands, from headers and masks; 0 for no bytes."""
    return len(check([b.info for b in each(data, samples=False)])) if len(data) else 0


def decode_first(data, mask: np.ndarray | None = None) -> Band:
    return Band(*reading.decode(data, mask), 0)


def decode(data, mask: np.ndarray | None = None) -> Band:
    band = decode_first(data, mask)
    strict(data, band.info)
    return band


def decode_mask(data, mask: np.ndarray | None = None) -> np.ndarray | None:
    """The mask alone, (height, width), or None; no sample is decoded."""
    info, found = reading.inspect(data, False, mask, want_mask=True)
    strict(data, info)
    return None if found is None else found.reshape(info.mask_shape)


def decode_set(data, mask: np.ndarray | None = None) -> list[Band]:
    bands = list(each(data, mask))
    check([b.info for b in bands])
    return bands


def typed(band: Band, name: str | None = None) -> np.ndarray:
    """Samples in the blob's own type, or in f64; another is an error."""
    name = name or band.info.data_type
    if name not in (band.info.data_type, "f64"):
        fail("InvalidArgument", f"the blob has {band.info.data_type} samples, not {name}")
    return through(band.values, name).astype(dtype(name)).reshape(band.info.raster_shape)


def stacked(bands: list[Band], layout: str = "interleaved", name: str | None = None) -> np.ndarray:
    """All bands as one array: bands last (interleaved: height, width, bands[, depth]) or first (bsq)."""
    if layout not in ("interleaved", "bsq"):
        fail("InvalidArgument", f"unknown layout {layout}")
    parts = [typed(b, name) for b in bands]
    if len(parts) == 1:
        return parts[0]
    return np.stack(parts, axis=0 if layout == "bsq" else 2)


def band_masks(bands: list[Band]) -> np.ndarray | None:
    """(height, width[, bands]) of 0 and 1; None if no band has a mask."""
    if all(b.mask is None for b in bands):
        return None
    parts = [np.ones(b.info.mask_shape, np.uint8) if b.mask is None else b.mask.reshape(b.info.mask_shape).astype(np.uint8) for b in bands]
    return parts[0] if len(parts) == 1 else np.stack(parts, axis=2)


def mask_count(bands: list[Band]) -> int:
    """0 without masks, 1 if one is shared, else the number of bands."""
    found = [b.mask for b in bands]
    if all(m is None for m in found):
        return 0
    shared = all(m is not None and np.array_equal(m, found[0]) for m in found)
    return 1 if shared else len(found)


def frames(stream, limit: int = 512 << 20) -> Iterator[bytes]:
    """One blob after the other from a binary stream, each by the lengths in its header.

    Ends at a clean end; an end within a blob is Truncated. In the first family a blob
    without a mask section of its own can follow one with it: it is told by its block grid,
    whose counts stand where a mask section has a mask's.
    """

    def more(have: bytes, n: int) -> bytes:
        while len(have) < n:
            part = stream.read(n - len(have))
            if not part:
                fail("Truncated", f"{n} bytes are needed, {len(have)} are there")
            have += part
        return have

    while True:
        first = stream.read(1)
        if not first:
            return
        head = more(first, 10)
        if reading.family(head) == 2:
            version = int.from_bytes(head[6:10], "little", signed=True)
            if not 1 <= version <= 6:
                fail("UnsupportedVersion", str(max(version, 0)))
            place = {1: 26, 2: 26, 3: 30}.get(version, 34)
            head = more(head, place + 4)
            size = int.from_bytes(head[place:], "little", signed=True)
            if size <= 0:
                fail("InvalidHeader", "the blob size must be above zero")
            if size > limit:
                fail("InvalidBlob", "the blob is over the limit")
            yield more(head, size)
            continue
        head = more(head, 50)
        size = int.from_bytes(head[42:46], "little")
        # A mask section has an empty grid; one with a grid is the samples' own.
        if int.from_bytes(head[34:38], "little") or int.from_bytes(head[38:42], "little"):
            if size > limit:
                fail("InvalidBlob", "the blob is over the limit")
            yield more(head, 50 + size)
            continue
        if size > limit:
            fail("InvalidBlob", "the blob is over the limit")
        head = more(head, 50 + size + 16)
        second = int.from_bytes(head[50 + size + 8 : 50 + size + 12], "little")
        if size + second > limit:
            fail("InvalidBlob", "the blob is over the limit")
        yield more(head, 50 + size + 16 + second)
