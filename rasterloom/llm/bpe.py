"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Compiled from a public vocabulary file of byte-level merges:

* an Aho-Corasick automaton over the tokens' bytes, reversed: run over a reversed piece, it meets
  at each place first the longest token that starts there;
* for each token the longest token that is a proper prefix of it;
* a table of compatible pairs: a and b are compatible if merging the bytes of both leaves a and b.
  The tokens that touch the boundary are those on a's right spine and b's left spine, each from its
  own merge on until that of its parent; a pair of them merges across the boundary if its rank comes
  before both parents' (left of two equal pairs first). Ranks grow from parts to the whole (checked),
  so a walk down both spines, from the younger side, sees every pair that ever meets. Answers are kept.

A sequence of tokens is what merging yields exactly if each two neighbours are compatible. So the
encoder goes from left to right with the longest token that is compatible with the one before, tries
its prefixes next, and steps back where none fits. What merging yields of a prefix of the piece is
unique, so a place from which nothing fits is never tried again: the time is linear in the piece.

Decoding gathers the tokens' bytes from one array by a table of offsets.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from rasterloom.llm import tokens
from rasterloom.llm.common import prefer_names, tidy

#: The pre-tokenizer's pattern, a fixed value: contractions, runs of letters, numbers and other signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs whose compatibility a worker remembers; it only saves time.
KEPT_PAIRS = 300_000
#: Arcs of the automaton with those that failing has found; more are found anew each time.
KEPT_STEPS = 500_000
ROWS = 200
_NEVER = 1 << 60
_LOADED: dict[tuple[str, bool], "Encoder"] = {}
_TABLES: dict[str, "Tables"] = {}


def _automaton(tokens_of: dict[bytes, int]) -> tuple[dict[int, int], list[int], list[int]]:
    """The Aho-Corasick automaton of the reversed tokens: arcs (state << 8 | byte to state; 0 is the root), for each
    state that of its longest proper suffix, and the longest token that ends there, read backwards (-1: none)."""
    steps, own, order, fails = {}, [-1], [], [0]
    for raw, i in tokens_of.items():
        at = 0
        for b in raw[::-1]:
            to = steps.get(at << 8 | b)
            if to is None:
                to = steps[at << 8 | b] = len(own)
                own.append(-1)
                fails.append(0)
                order.append((at, b, to))
            at = to
        own[at] = i
    depth = [0] * len(own)
    for at, _, to in order:
        depth[to] = depth[at] + 1
    for at, b, to in sorted(order, key=lambda arc: depth[arc[2]]):
        if at:
            suffix = fails[at]
            while suffix and (suffix << 8 | b) not in steps:
                suffix = fails[suffix]
            fails[to] = steps.get(suffix << 8 | b, 0)
        if own[to] < 0:
            own[to] = own[fails[to]]
    return steps, fails, own


class Tables:
    """What is compiled from a vocabulary. Refused (ValueError): one without all single bytes, or whose merges
    come before those of their parts."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        octet = {c: b for b, c in tokens._byte_letters().items()}
        self.spelled: list[bytes] = [b""] * (max([*vocabulary.values(), *(added or {}).values()], default=-1) + 1)
        for name, i in vocabulary.items():
            self.spelled[i] = bytes(octet[c] for c in name) if all(c in octet for c in name) else name.encode()
        self.added = dict(added or {})
        for name, i in self.added.items():
            self.spelled[i] = name.encode()
        self.offsets = np.cumsum([0, *map(len, self.spelled)])
        self.octets = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.length = [len(s) for s in self.spelled]
        #: By id: rank of the merge that makes it (-1: a byte, or no token of merges) and its parts.
        self.rank, self.left, self.right = ([-1] * len(self.spelled) for _ in range(3))
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            i, j, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if any(self.length[p] > 1 and self.rank[p] < 0 for p in (i, j)) or self.rank[whole] >= 0:
                raise ValueError(f"merge {rank} isn't after those of its parts")
            self.joined[i, j] = rank
            self.rank[whole], self.left[whole], self.right[whole] = rank, i, j
        self.pairs: dict[tuple[int, int], bool] = {}
        self.id_of = {self.spelled[i]: i for i in vocabulary.values() if len(self.spelled[i]) == 1}
        if len(self.id_of) != 256:
            raise ValueError("the vocabulary must have all 256 bytes")
        # Only tokens that merging can yield at all: their parts can, and nothing crosses between these before.
        for i in sorted((i for i in vocabulary.values() if self.rank[i] >= 0), key=self.rank.__getitem__):
            a, b = self.left[i], self.right[i]
            if self.spelled[a] in self.id_of and self.spelled[b] in self.id_of and self._walk(a, b, self.rank[i]):
                self.id_of[self.spelled[i]] = i
        self.shorter = [-1] * len(self.spelled)
        for raw, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.id_of), -1)
        self.steps, self.fails, self.ends = _automaton(self.id_of)

    def _walk(self, a: int, b: int, before: int = _NEVER) -> bool:
        rank, joined = self.rank, self.joined
        parent_a = parent_b = before
        while True:
            r = joined.get((a, b))
            if r is not None and r < parent_a and r <= parent_b:
                return False
            if rank[a] > rank[b]:
                parent_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                parent_b, b = rank[b], self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a and b, side by side, as they are."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._walk(a, b)
        return found

    def longest(self, piece: bytes) -> list[int]:
        """The longest token that starts at each place, from the last place to the first."""
        steps, ends, state, found = self.steps, self.ends, 0, []
        for b in piece[::-1]:
            to = steps.get(state << 8 | b)
            if to is None:
                to = self._after_failing(state, b)
            state = to
            found.append(ends[state])
        return found

    def _after_failing(self, state: int, b: int) -> int:
        """The step from a state without an arc for b, by the longest suffix that has one; kept, as long as there is room."""
        at = state
        while at and (at << 8 | b) not in self.steps:
            at = self.fails[at]
        to = self.steps.get(at << 8 | b, 0)
        if len(self.steps) < KEPT_STEPS:
            self.steps[state << 8 | b] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        """The ids that merging yields of the piece's bytes."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        longest, length, shorter, known = self.longest(piece), self.length, self.shorter, self.pairs
        open_at, ids, at, last = bytearray(b"\1") * (len(piece) + 1), [], 0, len(piece) - 1
        before, i = -1, longest[last] if piece else -1
        while at <= last:
            while i >= 0:
                if open_at[at + length[i]]:
                    fits = before < 0 or known.get((before, i))
                    if fits or fits is None and self.compatible(before, i):
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                at += length[i]
                before = i
                if at > last:
                    break
                i = longest[last - at]
            else:  # nothing fits here: the token before must be a shorter one
                open_at[at] = 0
                i = ids.pop()
                at -= length[i]
                before, i = ids[-1] if ids else -1, shorter[i]
        return ids

    def octets_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all ids in order, the number of bytes of each). Ids without a token have none."""
        ids = np.where(ids < len(self.spelled), ids, 0) if len(self.spelled) else ids
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        end = np.cumsum(size)
        at = np.repeat(begin - end + size, size)
        at += np.arange(len(at))
        return self.octets[at], size

    def decode(self, ids: bytes) -> str:
        """The text of ids as little-endian unsigned 32-bit integers; bytes that aren't UTF-8 are U+FFFD, unknown ids nothing."""
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        return self.octets_of(found[found < len(self.spelled)])[0].tobytes().decode("utf-8", "replace")


def tables(path: str) -> Tables:
    """One a worker process and vocabulary file."""
    if path not in _TABLES:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
        _TABLES[path] = Tables(found["model"]["vocab"], merges, {t["content"]: t["id"] for t in found["added_tokens"]})
        del found, merges
        tidy()
    return _TABLES[path]


class Encoder(tokens.Encoder):
    """Whole texts, cut and cached as tokens.Encoder does; the merging is Tables'. special: whether the string of
    an added token in a text is that token (as the library's plain call has it) or plain text."""

    def __init__(self, path: str, special: bool = True, kept_bytes: int = tokens.KEPT_BYTES):
        import regex

        self.kind, self.tables, self.known = "byte", tables(path), tokens.Kept(kept_bytes)
        added = sorted(self.tables.added, key=len, reverse=True) if special else []
        self.marks = sorted({a[:2] for a in added})
        self.cut = regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def _units(self, text: str) -> list[str]:
        # A first space before anything but white space belongs to the first piece, as a space within does.
        if "\x00" in text or tokens._ODD_SPACE.search(text[1:] if text[:1] == " " else text):
            return [text]
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def _pieces(self, text: str) -> bytes:
        found = []
        for piece in self.cut(text):
            ids = self.known.get(piece)
            if ids is None:
                ids = array("I", self.tables.encode(piece.encode())).tobytes()
                self.known.put(piece, ids)
            found.append(ids)
        return b"".join(found)

    def _encode_unit(self, unit: str) -> bytes:
        core = unit.rstrip(tokens._TAIL)
        bare = core[1:] if core[:1] == " " else core
        if len(core) < len(unit) and bare and bare[-1].isalpha():
            return self.ids_of(core) + self.ids_of(unit[len(core) :])
        if bare.isalpha() and max(bare) < "\u0100":  # one piece for sure
            return array("I", self.tables.encode(core.encode())).tobytes()
        return self._pieces(unit)

    def _whole(self, text: str) -> bytes:
        if not self.added:
            return self._pieces(text)
        special = self.tables.added
        return b"".join([special[p].to_bytes(4, "little") if p in special else self._pieces(p) for p in self.added.split(text)])


def encoder(path: str, special: bool = True) -> Encoder:
    """One a worker process, vocabulary and choice."""
    if (path, special) not in _LOADED:
        _LOADED[path, special] = Encoder(path, special)
    return _LOADED[path, special]


def _parts(batches) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def id_lists(raw: list[bytes]):
    """An Arrow array of lists of ids."""
    import pyarrow as pa

    offsets = np.cumsum([0, *[len(r) // 4 for r in raw]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def encode(docs: DataFrame, vocabulary: str, special: bool = True) -> DataFrame:
    """(doc_id, ids) for each row; a null or empty text has no ids. Rows of equal or null doc_id are
    encoded each; texts of any length are encoded whole; an empty table gives no rows; other columns
    are not read."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary, special)
        for part in _parts(batches):
            raw = [enc.encode(t) if t else b"" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), id_lists(raw)], names=["doc_id", "ids"])
        tidy()

    return prefer_names(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids have a null text, ids without a token nothing."""

    def run(batches):
        import pyarrow as pa

        t = tables(vocabulary)
        for part in _parts(batches):
            texts = [None if ids is None else t.decode(array("I", ids).tobytes()) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
        tidy()

    return prefer_names(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded (the text of these ids) for
    each row, in one pass. Nulls, repeated rows, very long texts and empty tables are as in encode(): a null
    text decodes to an empty one."""

    def run(batches):
        import pyarrow as pa

        enc, t = encoder(vocabulary), tables(vocabulary)
        for part in _parts(batches):
            raw = [enc.encode(x) if x else b"" for x in part.column(1).to_pylist()]
            cols = [part.column(0), pa.array(raw, pa.binary()), pa.array([t.decode(r) for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"])
        tidy()

    return prefer_names(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
