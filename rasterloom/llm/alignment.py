"""Alignment of two tokenizers' tokens over the same bytes.

A (byte-level merges) reads a space and the text, B (pieces) reads the text and puts the space there
itself, so both spell the same bytes. The ends of each side's tokens are a packed bitset over these
bytes; AND of both has the shared cuts. A directory of popcounts ranks a cut in each side's bitset,
which turns shared cuts into ranges of tokens: the groups. The last A and the last B token of a group
are linked, since their byte ranges end together.

Of two linked tokens one spells the end of the other. So the pairs that can be linked at all follow from
the two vocabularies: each token's suffixes that the other side has. Counts of linked pairs over the
corpus are an array over these pairs, whose size doesn't depend on the corpus; it is broadcast.

Both sides cut a text at spaces, line feeds and punctuation behind letters (checked for B's pieces), and so does
the alignment: each distinct unit of many rows is encoded and aligned once, and what it gives is gathered to all
its places. Texts with other white space are aligned whole.
"""

from __future__ import annotations

import re

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import bpe, tokens, wfst
from rasterloom.llm.common import prefer_names, tidy, written

#: Rows and code points that are aligned together as whole texts.
ROWS, TOGETHER = 200, 200_000
#: Rows and bytes whose units are aligned together.
UNIT_ROWS, UNIT_BYTES = 800, 2_500_000
COLUMNS = ["a", "b", "a_sizes", "b_sizes", "links"]
#: Bytes of units that each side's encoder keeps for whole texts, and aligned units that are kept; both only save time.
KEPT_BYTES, KEPT_UNITS = 12_000_000, 200_000
#: Row groups of the written table, whose rows take 12 kB for a text of 3 kB.
GROUP_BYTES = 16_000_000
#: Where tokens.cut() cuts inside of words.
_INNER_CUT = re.compile(f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][{re.escape(tokens._TAIL)}]|.\n|\n.", re.DOTALL)


class Pairs:
    """All (A id, B id) of which one spells the end of the other, in ascending order, and their B ids."""

    def __init__(self, a_spelled: list[bytes], b_spelled: list[bytes]):
        self.n_b = len(b_spelled)
        by_a, by_b = self._by_bytes(a_spelled), self._by_bytes(b_spelled)
        keys = set()
        for mine, theirs, key in ((by_a, by_b, lambda i, j: i * self.n_b + j), (by_b, by_a, lambda i, j: j * self.n_b + i)):
            for raw, ids in mine.items():
                for at in range(len(raw)):
                    for j in theirs.get(raw[at:], ()):
                        keys.update(key(i, j) for i in ids)
        self.keys = np.array(sorted(keys), dtype=np.int64)
        self.b = self.keys % max(1, self.n_b)

    @staticmethod
    def _by_bytes(spelled: list[bytes]) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for i, raw in enumerate(spelled):
            found.setdefault(raw, []).append(i)
        found.pop(b"", None)
        return found

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.n_b + b)


class _Spelling:
    """Bytes of ids by a table of offsets."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.offsets = np.cumsum([0, *map(len, spelled)])
        self.octets = np.frombuffer(b"".join(spelled), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        end = np.cumsum(size)
        at = np.repeat(begin - end + size, size)
        at += np.arange(len(at))
        return self.octets[at], size


class Bits:
    """A packed bitset with a directory of popcounts, one for each 64-bit word."""

    def __init__(self, places: np.ndarray, size: int):
        marks = np.zeros(-(-max(size, 1) // 64) * 64, np.uint8)
        marks[places] = 1
        self.words = np.packbits(marks, bitorder="little").view("<u8")
        self._count()

    def _count(self) -> None:
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))

    def __and__(self, other: "Bits") -> "Bits":
        both = object.__new__(Bits)
        both.words = self.words & other.words
        both._count()
        return both

    def select(self) -> np.ndarray:
        """The places of all bits, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """So many bits are at or before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)


class Aligner:
    """Both encoders, spellings and the pairs of two vocabulary files."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a, self.b = bpe.Encoder(byte_vocabulary, special=False, kept_bytes=KEPT_BYTES), wfst.transducer(piece_model)
        self.spell_a, self.spell_b = _Spelling(self.a.tables.spelled), _Spelling(list(self.b.surface))
        self.pairs = Pairs(self.spell_a.spelled, self.spell_b.spelled)
        self.b.known = tokens.Kept(KEPT_BYTES)
        #: How written columns are packed: ids in two bytes where they fit.
        self.kinds = ["<u2" if len(s.spelled) <= 1 << 16 else "<u4" for s in (self.spell_a, self.spell_b)]
        model = self.b.model
        self.by_units = model.first_space and model.escape_spaces and not model.strip_spaces and not any(_INNER_CUT.search(p) for p in model.pieces)
        self._forget_units()
        tidy()

    def _forget_units(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values, self.counts = [np.zeros(0, np.int32) for _ in COLUMNS], np.zeros((3, 0), np.int64)

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """([a, b, a_sizes, b_sizes, links] of all texts one after the other, and how many each text has of each)."""
        full = [t for t in texts if t]
        values, own = self._aligned([self.a.encode(" " + t) for t in full], self.b.encode_all(full), [b" " + t.encode() for t in full])
        counts = np.zeros((3, len(texts)), np.int64)
        counts[:, np.flatnonzero([bool(t) for t in texts])] = own
        return values, counts

    def align_column(self, column) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """As align(), of an Arrow array of strings; and the rows that have to be aligned as whole texts, and have nothing here."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_units:
            return [np.zeros(0, np.int32) for _ in COLUMNS], np.zeros((3, len(column)), np.int64), np.ones(len(column), bool)
        octets, begins = tokens.joined(pc.binary_join_element_wise(pa.scalar(" "), column.fill_null(""), ""))
        units, n_units, whole = tokens.cut(octets, begins)
        coded = units.dictionary_encode()
        places, values, counts = self._places(coded.dictionary.to_pylist(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        at = places[coded.indices.to_numpy()]
        ends = np.concatenate(([0], np.cumsum(n_units)))
        n = counts[:, at]
        if len(odd := np.flatnonzero(n[0] == 0)):  # a unit that isn't spelled: its text has no tokens
            bad = np.zeros(len(column), bool)
            bad[np.searchsorted(ends, odd, "right") - 1] = True
            n[:, np.repeat(bad, n_units)] = 0
        out = []
        for own, size, of in zip(counts, n, ((0,), (1,), (2, 3, 4))):
            begin = (np.cumsum(own) - own)[at]
            end = np.cumsum(size)
            where = np.repeat((begin - end + size).astype(np.int32), size)
            where += np.arange(len(where), dtype=np.int32)
            out += [values[k][where] for k in of]
        upto = np.concatenate((np.zeros((3, 1), np.int64), np.cumsum(n, axis=1)), axis=1)
        return out, np.diff(upto[:, ends], axis=1), whole

    def _places(self, units: list[bytes], often: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(the place of each unit, what all places have, how much each has). Those seen more than once are kept."""
        if len(self.known) >= KEPT_UNITS:
            self._forget_units()
        known = self.known
        places = np.array([known.get(u, -1) for u in units], np.int64)
        # New ones that are kept stand before the others.
        new = np.flatnonzero(places < 0)
        new = new[np.argsort(often[new] < 2, kind="stable")]
        if not len(new):
            return places, self.values, self.counts
        raw = [units[k] for k in new.tolist()]
        texts = [u.decode() for u in raw]
        own, counts = self._aligned([self.a._encode_unit(t) for t in texts], self.b.search_all([t.replace(" ", wfst.SPACE) for t in texts]), raw)
        before, keep = self.counts.shape[1], int((often[new] > 1).sum())
        places[new] = np.arange(before, before + len(new))
        values = [np.concatenate((x, y.astype(np.int32))) for x, y in zip(self.values, own)]
        counts = np.concatenate((self.counts, counts), axis=1)
        known.update(zip(raw[:keep], range(before, before + keep)))
        self.counts = counts[:, : before + keep].copy()
        self.values = [v[:n].copy() for v, n in zip(values, self.counts.sum(axis=1)[[0, 1, 2, 2, 2]].tolist())]
        return places, values, counts

    def _aligned(self, raw_a: list[bytes], raw_b: list[bytes], want: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """As align(), of both sides' ids of byte strings; one that either side doesn't spell has none."""
        ids, spelled = [], []
        for raw, spelling in ((raw_a, self.spell_a), (raw_b, self.spell_b)):
            of = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            octets, size = spelling.of(of)
            ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *[len(r) // 4 for r in raw]])]
            whole = octets.tobytes()
            ids.append(of)
            spelled.append([whole[x:y] == w for x, y, w in zip(ends.tolist(), ends[1:].tolist(), want)])
        same = [x and y for x, y in zip(*spelled)]
        sizes = [np.array([len(r) // 4 for r in raw], np.int64) for raw in (raw_a, raw_b)]
        if not all(same):
            ids = [of[np.repeat(same, n)] for of, n in zip(ids, sizes)]
            sizes = [np.where(same, n, 0) for n in sizes]
        ends = [np.cumsum(s.of(of)[1]) for s, of in zip((self.spell_a, self.spell_b), ids)]
        size = int(ends[0][-1]) if len(ends[0]) else 0
        bits = [Bits(e - 1, size) for e in ends]
        cuts = (bits[0] & bits[1]).select()
        upto = [b.rank(cuts) for b in bits]
        links = self.pairs.places(ids[0][upto[0] - 1], ids[1][upto[1] - 1])
        # A text's last byte is a cut: so many groups are up to it.
        groups = np.diff(np.searchsorted(upto[0], np.concatenate(([0], np.cumsum(sizes[0]))), "right"))
        return [*ids, *[np.diff(u, prepend=0) for u in upto], links], np.array([*sizes, groups])


@lru_cache(maxsize=2)
def aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    """One a worker process and vocabularies."""
    return Aligner(byte_vocabulary, piece_model)


def _forget() -> None:
    """Called where no text is encoded any more: a worker's encoders go, with what they keep."""
    aligner.cache_clear()
    for kept in (bpe._TABLES, bpe._LOADED, wfst._LOADED):
        kept.clear()
    tidy()


def _lists(values: np.ndarray, counts: np.ndarray):
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _packed(values: np.ndarray, counts: np.ndarray, kind: str):
    """As _lists(), each list as bytes: smaller in memory, and written in a fraction of the time."""
    import pyarrow as pa

    raw, cuts = values.astype(kind).tobytes(), (np.concatenate(([0], np.cumsum(counts))) * np.dtype(kind).itemsize).tolist()
    return pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())


def _unpacked(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many each row has)."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).astype(np.int64), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize


def _flags(sizes: np.ndarray, counts: np.ndarray):
    """For each row a bit for each token: whether a group ends there. counts: tokens by row."""
    import pyarrow as pa

    ends = np.zeros(int(counts.sum()), np.uint8)
    ends[np.cumsum(sizes) - 1] = 1
    cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
    return pa.array([np.packbits(ends[x:y]).tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())


def _unflagged(column, counts: np.ndarray) -> np.ndarray:
    """The sizes of all rows' groups."""
    ends = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p, n in zip(column.to_pylist(), counts.tolist())]
    return np.diff(np.flatnonzero(np.concatenate([np.zeros(0, np.uint8), *ends])), prepend=-1)


def _parts(batches):
    """Slices of batches; a batch is let go before the next one is read, if the caller lets its slice go."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
        del batch


def _slices(batch, texts: list[str]):
    """(from, to) of so many rows that their texts are aligned together."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= TOGETHER or k + 1 - start == ROWS or k + 1 == len(texts):
            yield start, k + 1
            start, held = k + 1, 0


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, the ids a and b, how many tokens of each side each group has (a_sizes, b_sizes), and the link of each
    group as its place among Pairs, for each row.

    A null or empty text, or one that either side doesn't spell byte by byte (such as one with U+2581),
    has empty lists. Rows of equal or null doc_id are aligned each; texts are read whole, however long;
    an empty table gives no rows; other columns are not read.
    """
    return _aligned(docs, byte_vocabulary, piece_model, False)


def _aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str, packed: bool) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        both = aligner(byte_vocabulary, piece_model)

        def columns(doc_ids, values, counts):
            (a, b, a_sizes, b_sizes, links), (n_a, n_b, n) = values, counts
            if packed:
                cols = [_packed(a, n_a, both.kinds[0]), _packed(b, n_b, both.kinds[1]), _flags(a_sizes, n_a), _flags(b_sizes, n_b), _packed(links, n, "<u4")]
            else:
                cols = [_lists(a, n_a), _lists(b, n_b), _lists(a_sizes, n), _lists(b_sizes, n), _lists(links, n)]
            return pa.RecordBatch.from_arrays([doc_ids, *cols], names=["doc_id", *COLUMNS])

        for batch in batches:
            for x, y in tokens.slices(batch.column(1), UNIT_ROWS, UNIT_BYTES):
                part = batch.slice(x, y - x)
                values, counts, whole = both.align_column(part.column(1))
                yield columns(part.column(0).filter(pa.array(~whole)), values, counts[:, ~whole])
                del values, counts
                rest = part.filter(pa.array(whole))
                for at in range(0, rest.num_rows, ROWS):
                    some = rest.slice(at, ROWS)
                    texts = [t or "" for t in some.column(1).to_pylist()]
                    for v, w in _slices(some, texts):
                        yield columns(some.column(0).slice(v, w - v), *both.align(texts[v:w]))
                tidy()  # what a slice takes besides its columns
            batch = part = None  # let go before the next one is read
        tidy()

    return prefer_names(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {'binary' if packed else 'array<int>'}" for c in COLUMNS))


def counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How often each of so many pairs is linked. A task adds up its rows; at most so many rows as pairs come from each."""

    def run(batches):
        import pyarrow as pa

        _forget()
        found = np.zeros(size, np.int64)
        for part in _parts(batches):
            found += np.bincount(_unpacked(part.column(0), "<u4")[0], minlength=size)
            del part
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["link", "n"])

    got = aligned.select("links").mapInArrow(run, "link int, n long").groupBy("link").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("link").to_numpy()] = got.column("n").to_numpy()
    return out


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids in rows of equal width, and which of them are written."""
    width = len(str(int(ids.max(initial=0))))
    powers = 10 ** np.arange(width - 1, -1, -1)
    return (ids[:, None] // powers % 10 + 48).astype(np.uint8), ids[:, None] >= np.where(powers == 1, 0, powers)


def spelled_groups(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups, and where each group ends in it."""
    group_a, group_b = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    at_a = np.arange(len(a)) + (np.cumsum(b_sizes) - b_sizes)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(a_sizes)[group_b]
    ids, after = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    last = np.cumsum(a_sizes + b_sizes) - 1
    after[last - b_sizes], after[last] = ord("|"), ord(";")
    digits, written_ones = _digits(ids)
    letters = np.concatenate([digits, after[:, None]], axis=1)
    keep = np.concatenate([written_ones, np.ones((len(ids), 1), bool)], axis=1)
    return letters[keep].tobytes(), np.cumsum(keep.sum(axis=1))[last]


def links(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked as often over all documents as any of
    its B id), count_sum (of these numbers over links) and groups (``a1,a2|b1;a3|b2,b3``) for each row; odd rows as in align()."""
    both = aligner(byte_vocabulary, piece_model)
    pairs, kinds = both.pairs, both.kinds
    aligned = written(_aligned(docs, byte_vocabulary, piece_model, True), "alignment", GROUP_BYTES)
    often = counts(aligned, len(pairs.keys))
    best = np.zeros(pairs.n_b, np.int64)
    np.maximum.at(best, pairs.b, often)
    shared = docs.sparkSession.sparkContext.broadcast((often, often == best[pairs.b]))  # as long as Pairs
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(batches):
        import pyarrow as pa

        _forget()
        often, top = shared.value
        for part in _parts(batches):
            (a, n_a), (b, n_b), (links, n) = [_unpacked(part.column(k), kind) for k, kind in ((1, kinds[0]), (2, kinds[1]), (5, "<u4"))]
            a_sizes, b_sizes = _unflagged(part.column(3), n_a), _unflagged(part.column(4), n_b)
            text, ends = spelled_groups(a, b, a_sizes, b_sizes)
            upto = np.concatenate(([0], np.cumsum(n)))
            cuts = np.concatenate(([0], ends))[upto]
            sums = [np.diff(np.concatenate(([0], np.cumsum(v)))[upto]) for v in (top[links], often[links])]
            groups = [text[x : max(x, y - 1)].decode() for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v) for v in (n_a, n_b, n, n, *sums)], pa.array(groups, pa.string())], names=fields)
            del part, a, b, links, a_sizes, b_sizes, text, groups
        tidy()

    return aligned.mapInArrow(run, ", ".join(f"{f} {'string' if f == 'groups' else 'long'}" for f in fields))
