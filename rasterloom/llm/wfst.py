"""SentencePiece encoding and decoding as a shortest path through weighted transducers.

Compiled from a public model, and composed with each input:

* the normaliser: arcs that rewrite letters (space to U+2581), with the model's own settings
  for a first U+2581 and for repeated spaces;
* the lexicon: a trie of the pieces as arrays of arcs (state, letter) to state; a state in
  which a piece ends has an arc of that piece's weight (its negated score) back to the root;
* byte fallback: for a letter that is no piece, an arc over the pieces of its bytes;
* the merge acceptor, for models of merges: its states are pieces, and an arc to the next
  piece costs 0 if byte-pair merging leaves the two beside each other, else infinity.

Composition is lazy: only pairs (place in the input, lexicon state) that are reached are
made, for all places of many inputs at once. Composed arcs are then relaxed in topological
order in the min-plus semiring: the cost to a place is the least of cost to an arc's
begin + its weight + the acceptor's arc. A sequence of pieces is what merging gives exactly
if each two neighbours are, so with the acceptor one state for each place has a finite
cost; without it (a unigram model) the least cost needs no other state either. So the
last piece and the cost are all that a place keeps.

Pieces never go on past a U+2581 behind another letter (checked when a model is compiled),
so an input is a chain of segments; each distinct one of a batch is searched once.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from rasterloom.llm.common import prefer_names, tidy
from rasterloom.llm.tokens import Kept

SPACE = "▁"
#: Segments that are searched together: enough to make numpy's calls cheap, few enough for its arrays to stay in a CPU's cache.
TOGETHER = 8192
#: Cost of a letter that is no piece, above that of the costliest piece.
FALLBACK_COST = 10.0
ROWS = 1000
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.iinfo(np.int64).max
_LOADED: dict[str, "Transducer"] = {}

#: Numbers of kinds of pieces, and of model types, in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, MERGES = 1, 2


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    merges: bool = True
    first_space: bool = True
    strip_spaces: bool = False
    escape_spaces: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> Model:
    """The model in a file. What the transducers don't have is refused: a normaliser with a table
    of characters, pieces set by users or unused, and white space as suffixes."""
    pieces, trainer, normaliser = [], {}, {}
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
    if normaliser.get(2) or trainer.get(24) or trainer.get(3, UNIGRAM) not in (UNIGRAM, MERGES):
        raise ValueError(f"{path}: a table of characters, suffixed white space and word models aren't supported")
    names, scores, kinds = zip(*pieces)
    return Model(names, scores, kinds, trainer.get(3, UNIGRAM) == MERGES, bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))


class Arcs:
    """A fixed map from numbers to numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, np.int64)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], _NONE), np.append(np.asarray(values, np.int64)[order], 0)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.values[at], missing)


class Transducer:
    def __init__(self, model: Model):
        if set(model.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces that are set by users or unused aren't supported")
        self.model = model
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        names = [model.pieces[i] for i in normal]
        self.ids = np.array([*normal, -1])  # the last stands for a letter that is no piece
        self.n, self.longest = len(names), max(map(len, names), default=1)
        scores = np.array([model.scores[i] for i in normal], dtype=float)
        self.weight = np.append(-scores, -scores.min(initial=0.0) + FALLBACK_COST)
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece goes on past a space")
        self._compile_merges(names, scores)
        self._compile_lexicon(names)
        self.bytes_from = next((i for i, k in enumerate(model.kinds) if k == BYTE), None)
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        own = {BYTE: lambda p: bytes([int(p[3:5], 16)]), NORMAL: lambda p: p.replace(SPACE, " ").encode()}
        self.surface = [own[k](p) if k in own else b"" for p, k in zip(model.pieces, model.kinds)]
        self.known = Kept()

    def _compile_merges(self, names: list[str], scores: np.ndarray) -> None:
        """Ranks of merges, the pairs that merge, and the last merge that makes each piece."""
        index = {p: i for i, p in enumerate(names)}
        sizes = np.array([len(p) for p in names], np.int64)
        self.rank = np.where(sizes > 1, np.unique(-scores, return_inverse=True)[1], -1) if self.n else sizes
        self.left, self.right = np.full(self.n, -1), np.full(self.n, -1)
        self.made = sizes == 1
        if not self.model.merges:
            self.made[:] = True
            return
        if missing := {c for p in names for c in p} - {p for p in names if len(p) == 1}:
            raise ValueError(f"letters of pieces are no pieces: {sorted(missing)[:5]}")
        splits = [(i, index[p[:k]], index[p[k:]]) for i, p in enumerate(names) for k in range(1, len(p)) if p[:k] in index and p[k:] in index]
        whole, left, right = np.array(splits, np.int64).reshape(-1, 3).T
        self.pairs = Arcs(left * self.n + right, self.rank[whole])
        for size in range(2, self.longest + 1):
            own = (sizes[whole] == size) & self.made[left] & self.made[right]
            t, a, b = whole[own], left[own], right[own]
            # What is left when all merges of better rank than the piece's own are done.
            good = self.beside(a, b, self.rank[t])
            self.left[t[good]], self.right[t[good]], self.made[t[good]] = a[good], b[good], True
        # Pieces that merging never makes take no part.
        whole, left, right = (x[self.made[whole]] for x in (whole, left, right))
        self.pairs = Arcs(left * self.n + right, self.rank[whole])

    def _compile_lexicon(self, names: list[str]) -> None:
        states: dict[tuple[int, str], int] = {}
        ends = {}
        for i, p in enumerate(names):
            if self.made[i]:
                state = 0
                for c in p:
                    state = states.setdefault((state, c), len(states) + 1)
                ends[state] = i
        keys = np.array([s << 21 | ord(c) for s, c in states], np.int64)
        self.trie = Arcs(keys, np.fromiter(states.values(), np.int64, len(states)))
        self.final = np.full(len(states) + 1, -1)
        self.final[np.fromiter(ends, np.int64, len(ends))] = np.fromiter(ends.values(), np.int64, len(ends))

    def beside(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """The merge acceptor's arcs: whether merging leaves each pair of pieces as it is (only
        merges of better rank than limit, if given). -1 and n stand for no piece: nothing merges there.

        Goes back in time over the pieces' last merges, the later of the two first, and looks
        at each step whether the two that then stood at the border would have merged before.
        Of equal merges the left one is done first.
        """
        ok = np.ones(len(left), dtype=bool)
        at = np.flatnonzero((left >= 0) & (left < self.n) & (right >= 0) & (right < self.n))
        a, b = left[at], right[at]
        limit = np.full(len(at), _NONE) if limit is None else limit[at]
        while len(at):
            bad = self.pairs.get(a * self.n + b, _NONE) < limit
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return ok

    def normalised(self, text: str) -> str:
        """The normaliser's composition with a text."""
        if self.model.strip_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.model.first_space:
            text = " " + text
        return text.replace(" ", SPACE) if self.model.escape_spaces else text

    def search(self, segments: list[str]) -> list[bytes]:
        """The ids on the path of least cost through each segment, as little-endian 32-bit integers.

        Time grows with the letters, and with the longest segment: places are relaxed by their
        distance from their segment's begin.
        """
        sizes = np.array([len(s) for s in segments], np.int64)
        text = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        limit = first[owner + 1]
        # Lazy composition of input and lexicon: all places go on together, a letter at a time.
        begin, state = np.arange(len(text)), np.zeros(len(text), np.int64)
        begins, ends, pieces = [], [], []
        for k in range(self.longest):
            state = self.trie.get(state << 21 | text[begin + k], -1)
            begin, state = begin[state >= 0], state[state >= 0]
            piece = self.final[state]
            hit = piece >= 0
            begins.append(begin[hit])
            ends.append(begin[hit] + k + 1)
            pieces.append(piece[hit])
            if k == 0:
                bare = np.ones(len(text), dtype=bool)
                bare[begin[hit]] = False
                bare = np.flatnonzero(bare)
                begins.append(bare)
                ends.append(bare + 1)
                pieces.append(np.full(len(bare), self.n))
            more = begin + k + 1 < limit[begin]
            begin, state = begin[more], state[more]
            if not len(begin):
                break
        begin, end, piece = (np.concatenate(x) for x in (begins, ends, pieces))
        # A place before each letter, and one behind each segment's last.
        own = owner[begin]
        source, target, depth = begin + own, end + own, end - first[own]
        order = np.argsort(depth, kind="stable")
        source, target, piece, start = source[order], target[order], piece[order], begin[order]
        edges = np.searchsorted(depth[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        cost = np.full(len(text) + len(sizes), np.inf)
        cost[first[:-1] + np.arange(len(sizes))] = 0.0
        last, by = np.full(len(cost), -1), np.full(len(cost), -1)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            to, new = target[a:b], cost[source[a:b]] + self.weight[piece[a:b]]
            if self.model.merges:
                new = np.where(self.beside(last[source[a:b]], piece[a:b]), new, np.inf)
            np.minimum.at(cost, to, new)
            best = np.flatnonzero((new == cost[to]) & np.isfinite(new))[::-1]  # of equal costs, the shorter last piece
            by[to[best]], last[to[best]] = a + best, piece[a:b][best]
        # Back along the arcs, all segments together.
        goal = first[1:] + np.arange(len(sizes))
        at, who = goal[sizes > 0], np.flatnonzero(sizes > 0)
        found, whose = [], []
        while len(at):
            arc = by[at]
            if (arc < 0).any():
                raise ValueError(f"no path through {segments[int(who[arc < 0][0])]!r}")
            found.append(arc)
            whose.append(who)
            at = source[arc]
            more = at > first[who] + who
            at, who = at[more], who[more]
        arcs = np.concatenate(found[::-1]) if found else np.zeros(0, np.int64)
        whose = np.concatenate(whose[::-1]) if whose else arcs
        order = np.argsort(whose, kind="stable")
        arcs, whose = arcs[order], whose[order]
        ids, counts = self._with_fallback(self.ids[piece[arcs]], text[start[arcs]], whose, len(sizes))
        raw, cuts = ids.astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _with_fallback(self, ids: np.ndarray, letters: np.ndarray, whose: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """ids with the bytes' pieces for letters that are no piece (their ids are -1), and their number by segment."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, np.bincount(whose, minlength=n)
        if self.bytes_from is None:
            spelled = [[self.unknown]] * len(bare)
        else:
            spelled = [[self.bytes_from + b for b in chr(c).encode("utf-8", "surrogatepass")] for c in letters[bare].tolist()]
        repeat = np.ones(len(ids), np.int64)
        repeat[bare] = [len(s) for s in spelled]
        place = np.cumsum(repeat) - repeat
        out = np.repeat(ids, repeat)
        for at, s in zip(place[bare].tolist(), spelled):
            out[at : at + len(s)] = s
        return out, np.bincount(whose, weights=repeat, minlength=n).astype(np.int64)

    def search_all(self, segments: list[str]) -> list[bytes]:
        """search() for any number of segments, those of like length together."""
        found: list[bytes] = [b""] * len(segments)
        order, at = sorted(range(len(segments)), key=lambda k: len(segments[k])), 0
        while at < len(order):
            to = at + max(1, min(TOGETHER, TOGETHER * 16 // max(1, len(segments[order[at]]))))
            for k, ids in zip(order[at:to], self.search([segments[k] for k in order[at:to]])):
                found[k] = ids
            at = to
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; an empty text has none."""
        cut = [_SEGMENT.findall(self.normalised(t)) if t else [] for t in texts]
        found = {s: self.known.get(s) for s in set().union(*cut)}
        new = [s for s, ids in found.items() if ids is None]
        for s, ids in zip(new, self.search_all(new)):
            found[s] = ids
            self.known.put(s, ids)
        return [b"".join(map(found.__getitem__, c)) for c in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The inverse path: each id's surface, joined, and the normaliser undone: U+2581 as spaces, but
        for the one put first; bytes that aren't UTF-8 as U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if self.model.first_space and raw[:1] == b" " else raw).decode("utf-8", "replace")


def transducer(model_file: str) -> Transducer:
    """One a worker process and model."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Transducer(read_model(model_file))
    return _LOADED[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids) for each row; a null or empty text has no ids. Rows of equal or null
    doc_id are encoded each; texts of any length are encoded whole; an empty table gives no
    rows; other columns are not read."""

    def run(batches):
        import pyarrow as pa

        t = transducer(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                raw = t.encode_all([x or "" for x in part.column(1).to_pylist()])
                offsets = np.cumsum([0, *[len(r) // 4 for r in raw]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])
        tidy()

    return prefer_names(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids have a null text."""

    def run(batches):
        import pyarrow as pa

        t = transducer(model_file)
        for batch in batches:
            texts = [None if ids is None else t.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
        tidy()

    return prefer_names(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    decoded_crc32 (of the decoded text in UTF-8) and same (it is the text again) for each row.

    Nulls and repeated rows are as in encode(). A text that has U+2581 itself decodes to
    spaces there and isn't the same.
    """

    def run(batches):
        import pyarrow as pa

        t = transducer(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [x or "" for x in part.column(1).to_pylist()]
                raw = t.encode_all(texts)
                back = [t.decode(array("I", ids)) for ids in raw]
                cols = [part.column(0), pa.array([len(ids) // 4 for ids in raw], pa.int64()), pa.array(list(map(zlib.crc32, raw)), pa.int64())]
                cols += [pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back)])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "same"])
        tidy()

    return prefer_names(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, same boolean")
