"""Huffman coding of 8-bit samples, plain or as differences from a neighbour."""

from __future__ import annotations

import heapq

import numpy as np

from rasterloom.codec import bits
from rasterloom.codec.model import Cursor, fail

#: The alphabet, and the longest codes that are read and written; and the bits that a table of short codes covers.
SYMBOLS, QUICK, LONGEST_READ, LONGEST_WRITTEN = 256, 12, 32, 31


def shift_of(data_type: str) -> int:
    return 128 if data_type == "i8" else 0


def code_lengths(counts: np.ndarray) -> dict[int, tuple[int, int]] | None:
    """symbol: (bits, code). The two rarest trees are joined again and again; of equally
    rare ones, that with the smaller least symbol, then the older. The rarer goes left (0)."""
    heap = [(int(n), s, i) for i, (s, n) in enumerate((s, n) for s, n in enumerate(counts) if n)]
    if not heap:
        return None
    parts: dict[int, tuple] = {i: (s,) for _, s, i in heap}
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parts[made] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), made))
        made += 1
    codes, open_ = {}, [(heap[0][2], 0, 0)]
    while open_:
        node, n, code = open_.pop()
        if len(parts[node]) == 1:
            codes[parts[node][0]] = (max(n, 1), code)
        else:
            open_ += [(parts[node][0], n + 1, code << 1), (parts[node][1], n + 1, code << 1 | 1)]
    return codes if max(n for n, _ in codes.values()) <= LONGEST_WRITTEN else None


def _words(text: str) -> bytes:
    """A string of binary digits as 32-bit words, most significant bit first."""
    digits = np.frombuffer((text + "0" * (-len(text) % 32)).encode(), np.uint8) - ord("0")
    return np.packbits(digits).view(">u4").astype("<u4").tobytes()


def table_bytes(codes: dict[int, tuple[int, int]]) -> bytes:
    first, last = min(codes), max(codes) + 1
    lengths = np.array([codes.get(s, (0, 0))[0] for s in range(first, last)])
    head = np.array([2, SYMBOLS, first, last], "<i4").tobytes()
    return head + bits.stuffed(lengths) + _words("".join(f"{c:0{n}b}" for s in sorted(codes) for n, c in [codes[s]]))


def differences(values: np.ndarray, valid: np.ndarray, shift: int) -> np.ndarray:
    """Symbols, by dimension, of each valid sample's difference from its left neighbour, else
    from the one above, else from the last valid one. values: (height, width, depth) integers."""
    h, w, depth = values.shape
    out = []
    for d in range(depth):
        v = values[:, :, d].astype(np.int64)
        order = np.flatnonzero(valid)
        before = np.zeros(h * w, np.int64)
        before[order[1:]] = v.reshape(-1)[order[:-1]]
        left = np.zeros((h, w), bool)
        left[:, 1:] = valid[:, :-1]
        above = np.zeros((h, w), bool)
        above[1:] = valid[:-1]
        guess = before.reshape(h, w).copy()
        use = above & ~left
        guess[use] = np.roll(v, 1, axis=0)[use]
        out.append(((v - guess + shift) & 255)[valid])
    return np.stack(out) if out else np.zeros((0, 0), np.int64)


def body(symbols: np.ndarray, codes: dict[int, tuple[int, int]]) -> bytes:
    """The codes of symbols and one word of zeros."""
    texts = [""] * SYMBOLS
    for s, (n, c) in codes.items():
        texts[s] = f"{c:0{n}b}"
    return _words("".join(map(texts.__getitem__, symbols.tolist()))) + bytes(4)


def candidate(symbols: np.ndarray):
    """(size, codes) for a stream of symbols, or None."""
    counts = np.bincount(symbols.reshape(-1), minlength=SYMBOLS)
    codes = code_lengths(counts)
    if codes is None:
        return None
    total = sum(int(counts[s]) * n for s, (n, _) in codes.items())
    return len(table_bytes(codes)) + 4 * (-(-total // 32) + 1), codes


class Stream:
    """Reads a table and then symbols; it takes all bytes that are left."""

    def __init__(self, cur: Cursor, version: int):
        if cur.left >= 4 and int.from_bytes(cur.data[cur.at : cur.at + 4], "little", signed=True) < 2:
            fail("UnsupportedFeature", "Huffman version below 2")
        _, size, first, last = cur.array("<i4", 4).tolist()
        if not 0 < size <= SYMBOLS or not 0 <= first < size or not 0 < last - first <= size:
            fail("InvalidBlob", "invalid Huffman table")
        lengths = np.zeros(last - first, np.int64)
        read = bits.read_stuffed(cur, version, last - first, None, 0.0, 0.0)
        lengths[: len(read)] = read
        if lengths.max() > LONGEST_READ:
            fail("InvalidBlob", "invalid Huffman code length")
        rest = bytes(cur.take(cur.left))
        words = np.frombuffer(rest + bytes(-len(rest) % 4), "<u4")
        self.flags = np.unpackbits(words.astype(">u4").view(np.uint8))
        self.codes: dict[tuple[int, int], int] = {}
        at = 0
        for i in range(first, last):
            n = int(lengths[i - first])
            if n:
                self.codes[n, self._peek(at, n)] = i % size
                at += n
        self.at = -(-at // 32) * 32
        self.longest = int(lengths.max())

    def _peek(self, at: int, n: int) -> int:
        if at // 32 * 32 >= len(self.flags):
            fail("Truncated", "Huffman data ends early")
        part = self.flags[at : at + n]
        return int("".join(map(str, part.tolist())).ljust(n, "0"), 2)

    def symbols(self, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.int64)
        quick = min(self.longest, QUICK)
        known, sizes = np.full(1 << quick, -1), np.zeros(1 << quick, np.int64)
        for (size, code), s in self.codes.items():
            if size <= quick:
                at = code << (quick - size)
                known[at : at + (1 << (quick - size))] = s
                sizes[at : at + (1 << (quick - size))] = size
        padded = np.concatenate((self.flags, np.zeros(quick, np.uint8))).astype(np.int64)
        window = np.zeros(len(self.flags), np.int64)
        for k in range(quick):
            window = window << 1 | padded[k : k + len(window)]
        sizes = sizes[window]
        steps, places, longer = sizes.tolist(), [], []
        at, end, note = self.at, len(steps), places.append
        for i in range(n):
            if at >= end:
                fail("Truncated", "Huffman data ends early")
            note(at)
            if steps[at]:
                at += steps[at]
                continue
            for size in range(quick + 1, self.longest + 1):
                s = self.codes.get((size, self._peek(at, size)))
                if s is not None:
                    longer.append((i, s))
                    at += size
                    break
            else:
                fail("InvalidBlob", "no Huffman code fits")
        out = known[window[places]]
        for i, s in longer:
            out[i] = s
        self.at = at
        return out


def restore(symbols: np.ndarray, valid: np.ndarray, shift: int) -> np.ndarray:
    """(height, width) values of one dimension's difference symbols, within the byte's range."""
    h, w = valid.shape
    if valid.all():
        delta = symbols.reshape(h, w).astype(np.int64) - shift
        delta[:, 0] = np.cumsum(delta[:, 0])
        return ((np.cumsum(delta, axis=1) + shift) & 255) - shift
    flat, ok = [0] * (h * w), valid.reshape(-1).tolist()
    before, at, deltas = 0, 0, (symbols - shift).tolist()
    for p in np.flatnonzero(valid).tolist():
        if p % w and ok[p - 1]:
            guess = before
        elif p >= w and ok[p - w]:
            guess = flat[p - w]
        else:
            guess = before
        before = flat[p] = ((deltas[at] + guess + shift) & 255) - shift
        at += 1
    return np.array(flat).reshape(h, w)
