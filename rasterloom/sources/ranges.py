"""Where the blobs of files lie, from their headers alone, and byte ranges of about equal size made of them.

An index row is one blob: its file, its number there (band), its first byte and length, and, for a blob that
takes over a mask, where the blob lies that has it. Headers are hopped over with one short read each, so an
index costs no samples and no masks. A range is read on its own: its bytes, and that one blob's mask.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Bytes of a header that tell all that is asked here; of the first family, up to the end of its mask section's own head.
HEAD = 94
INDEX = "path string, band int, at long, length long, mask_at long, mask_length long"


@dataclass(frozen=True)
class Entry:
    """One blob of a file. mask_at is -1 where no mask is taken over."""

    path: str
    band: int
    at: int
    length: int
    mask_at: int = -1
    mask_length: int = 0


def _second_family(head: bytes, rest: int) -> tuple[int, str] | None:
    """(bytes, mask encoding) as the header tells; None if it can't be hopped over."""
    version = struct.unpack_from("<i", head, 6)[0] if len(head) >= 10 else 0
    if not 1 <= version <= 6:
        return None
    more = 4 * (version >= 3)
    at_mask = {1: 58, 2: 58, 3: 62, 4: 66, 5: 66}.get(version, 90)
    if len(head) < at_mask + 4:
        return None
    height, width = struct.unpack_from("<II", head, 10 + more)
    valid, _, size = struct.unpack_from("<Iii", head, 18 + more + 4 * (version >= 4))
    (n,) = struct.unpack_from("<I", head, at_mask)
    if not 0 < size <= rest:
        return None
    if valid == width * height:
        return size, "None"
    return size, "ImplicitAllInvalid" if valid == 0 else "Explicit" if n else "External"


def _first_family(head: bytes, rest: int, read) -> tuple[int, str] | None:
    """As _second_family(); read(place, n) gives bytes of the blob."""
    if len(head) < 50:
        return None
    by, bx, n = struct.unpack_from("<III", head, 34)
    if by or bx:  # the samples' own grid: no mask section before it
        size, kind = 50 + n, "External"
    else:
        second = read(50 + n, 16)
        if len(second) < 16:
            return None
        size = 66 + n + struct.unpack_from("<I", second, 8)[0]
        kind = "Explicit" if n else "None" if struct.unpack_from("<f", head, 46)[0] else "ImplicitAllInvalid"
    return (size, kind) if size <= rest else None


def hop(path: str) -> Iterator[Entry]:
    """The blobs of a file, one after the other. From the first on that its header doesn't tell the end of,
    the rest of the file is one entry: reading it tells the error."""
    total, at, band, owner, last = os.path.getsize(path), 0, 0, None, None
    with open(path, "rb") as f:

        def read(place: int, n: int) -> bytes:
            f.seek(at + place)
            return f.read(n)

        while at < total:
            head = read(0, HEAD)
            family = 2 if head.startswith(b"Lerc2 ") else 1 if head.startswith(b"CntZImage") else 0
            if family != last:
                owner = None
            found = _second_family(head, total - at) if family == 2 else _first_family(head, total - at, read) if family else None
            size, kind = found or (total - at, "External")
            if kind != "External":
                owner = (at, size) if kind in ("Explicit", "ImplicitAllInvalid") else None
            yield Entry(path, band, at, size, *(owner if kind == "External" and owner else (-1, 0)))
            at, band, last = at + size, band + 1, family


def index(paths: DataFrame) -> DataFrame:
    """INDEX rows of the files that the column path names, a file a row: made where the rows are. Paths are those
    that executors can open (a mounted folder); an empty file has no blobs, a null path none either."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [tuple(getattr(e, n) for n in names) for e in hop(path.removeprefix("file:"))] if path else []
                for at in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 50_000]), (pa.string(), pa.int32(), *[pa.int64()] * 4))], names=names)

    return paths.select("path").mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Range:
    """Blobs of one file that follow one another. over: one blob that is too large to be read."""

    path: str
    band: int
    at: int
    length: int
    mask_at: int = -1
    mask_length: int = 0
    over: bool = False


def balanced(entries: Iterator[Entry], split_bytes: int, least: int, limit: int = 512 << 20) -> list[list[Range]]:
    """Ranges in groups of about split_bytes, or less, so that there are least groups where there are so many blobs.

    A group has as many bytes as its share, to within one blob; files are in order, and small ones share a group.
    """
    entries = list(entries)
    total = sum(e.length for e in entries)
    share = max(1.0, min(split_bytes, total / max(1, least)))
    groups: list[list[Range]] = []
    done, end = 0, None
    for e in entries:
        k = int((done + e.length / 2) / share)
        if not groups or k != end:
            groups.append([])
            end = k
        group, over = groups[-1], e.length > limit
        r = group[-1] if group else None
        if r and not over and not r.over and r.path == e.path and r.at + r.length == e.at:
            group[-1] = Range(r.path, r.band, r.at, r.length + e.length, r.mask_at, r.mask_length)
        else:
            group.append(Range(e.path, e.band, e.at, e.length, e.mask_at, e.mask_length, over))
        done += e.length
    return groups


def read(r: Range) -> tuple[bytes, bytes]:
    """(the range's bytes, those of the blob whose mask its first blob takes over): nothing else of the file is read."""
    with open(r.path, "rb") as f:
        f.seek(r.at)
        data = f.read(r.length)
        if r.mask_at < 0:
            return data, b""
        f.seek(r.mask_at)
        return data, f.read(r.mask_length)
