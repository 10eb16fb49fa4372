"""Removal of repeated passages by suffix trees that are partitioned by prefix.

The suffixes are those of each text's word sequence, at each word that has a window of
``window`` (13) words. Only the top of the tree matters, so a suffix is its path of two
loci: the node of its first ``PREFIX`` (5) words and the node of its whole window, each
known by a hash of the words above it. An inner node at window depth with suffixes of
two documents is a repeat; where marked windows overlap they join to maximal repeats.

1. Census. Texts are dealt once into shards that fit in memory. A shard names the
   prefixes of its suffixes (40 bits of their hashes, sorted, as deltas in byte planes,
   each prefix once); for each range of prefixes, a task answers each shard with a bit
   for each: does another shard have it too? A prefix that only one shard has needs no
   subtree elsewhere. One more bit tells prefixes that very many shards have.
2. Subtrees. Suffixes below shared prefixes go to groups, each suffix once a shard: by
   their prefix, or, below a prefix that very many shards have, by the longer prefix of
   the whole window. So a group has a bounded part of the suffixes, and a passage that a
   third of all documents share adds one entry a shard, not one a document. A group sorts
   its suffixes by path and answers each shard with a bit for each: is there a
   smaller document below the same deep node?
3. Marking. Each shard marks the windows with such an answer, and those whose window
   has a smaller document in the shard itself, and removes the words they cover.

All steps read one exchange of the texts, which Spark reuses. A lost executor's shards
are read again from it, and hold the same documents: a shard is a hash of doc_id.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm.common import shards_for, tidy, unlike

WINDOW, PREFIX, CODE_BITS = 13, 5, 40
SHARD_MB = 4
#: From so many shards on, a prefix is too common for a group of its own.
COMMON_SHARDS = 1000
CHUNK_BYTES = 2_000_000
MESSAGE = "bucket int, shard int, n int, body binary"
ANSWER = "step int, shard int, bucket int, n int, body binary"

_U = np.uint64
#: Odd multipliers of the hashes, and the start of the byte table; any would do.
_BASE, _STEP, _MIX, _TABLE_SEED = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xBF58476D1CE4E5B9), 13
_TABLE = np.random.Generator(np.random.PCG64(_TABLE_SEED)).integers(1, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 2**64))
    return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(n, b, _U)))) for b in (_BASE, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _MIX
    return x ^ x >> _U(29)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first byte, hash) of each word, from sums of bytes times powers of a base."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    size = 1 << max(16, int(len(raw)).bit_length())
    power, inverse = _powers(size)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[raw], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_TABLE[raw] * power[: len(raw)], dtype=_U)))
    return starts, _mixed((sums[ends] - sums[starts]) * inverse[starts])


class Shard:
    """The suffixes of a shard's documents, in order of doc_id, and their paths."""

    def __init__(self, docs, window: int, prefix: int):
        """docs: Arrow table (shard, doc_id, text)."""
        ids = docs.column("doc_id").to_pylist()
        order = sorted((i for i in range(len(ids))), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.rows = order
        self.doc_id = np.array([ids[i] or 0 for i in order], dtype=np.int64)
        known = np.array([ids[i] is not None for i in order], dtype=bool)
        self.text = docs.column("text")
        self.n_words = np.zeros(len(order), dtype=np.int64)
        self.window = window
        doc, at, code, locus = [], [], [], []
        chunk, held = [], 0
        for k in range(len(order)):
            chunk.append(k)
            held += len(self.bytes_of(k))
            if held < CHUNK_BYTES and k < len(order) - 1:
                continue
            parts = [self.bytes_of(j) for j in chunk]
            starts, words = word_hashes(b" ".join(parts))
            firsts = np.cumsum([0, *[len(p) + 1 for p in parts]])
            edges = np.searchsorted(starts, firsts)  # of words, by document
            counts = np.diff(edges)
            self.n_words[chunk] = counts
            if len(words) >= window:
                sums, path = np.zeros(len(words) - window + 1, _U), []
                for j in range(window):
                    sums = (sums + words[j : j + len(sums)]) * _STEP
                    if j + 1 in (prefix, window):
                        path.append(_mixed(sums))
                own = np.repeat(np.arange(len(chunk)), counts)
                whole = (own[: len(sums)] == own[window - 1 :]) & known[np.array(chunk)[own[: len(sums)]]]
                place = np.flatnonzero(whole)
                doc.append(np.array(chunk, dtype=np.int32)[own[place]])
                at.append((place - edges[own[place]]).astype(np.int32))
                code.append(path[0][place] >> _U(64 - CODE_BITS))
                locus.append(path[1][place])
            chunk, held = [], 0
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.at, self.code, self.locus = join(doc, np.int32), join(at, np.int32), join(code, _U), join(locus, _U)

    def bytes_of(self, k: int) -> bytes:
        value = self.text[self.rows[k]]
        return value.as_buffer().to_pybytes() if value.is_valid else b""

    def prefixes(self):
        """Distinct codes, each suffix's place among them, and whether two documents have the code."""
        if not len(self.code):  # no text here has a whole window
            return self.code, np.zeros(0, np.int64), np.zeros(0, bool)
        order = np.argsort(self.code, kind="stable")
        code = self.code[order]
        first = np.concatenate(([True], code[1:] != code[:-1]))
        place = np.empty(len(code), dtype=np.int64)
        place[order] = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        ends = np.append(begin[1:], len(code)) - 1
        doc = self.doc_id[self.doc[order]]
        return code[begin], place, doc[begin] != doc[ends]

    def nodes(self, elsewhere: np.ndarray, common: np.ndarray, groups: int):
        """Deep nodes below prefixes that two documents have: (group, code, locus, least doc_id, sent), and each suffix's node or -1."""
        codes, place, twice = self.prefixes()
        some = np.flatnonzero((elsewhere | twice)[place])
        order = some[np.lexsort((self.locus[some], self.code[some]))]  # stable: documents stay in order
        code, locus = self.code[order], self.locus[order]
        first = np.concatenate(([True], (code[1:] != code[:-1]) | (locus[1:] != locus[:-1]))) if len(order) else np.zeros(0, bool)
        node = np.full(len(self.code), -1, dtype=np.int64)
        node[order] = np.cumsum(first) - 1
        begin = order[first]
        group = np.where(common[place[begin]], _mixed(self.locus[begin]), _mixed(self.code[begin] * _STEP)) % _U(groups)
        return group.astype(np.int64), self.code[begin], self.locus[begin], self.doc_id[self.doc[begin]], elsewhere[place[begin]], node

    def marked(self, least: np.ndarray, smaller: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """For each document, the words that windows with a smaller document cover."""
        some = np.flatnonzero(node >= 0)
        hit = some[smaller[node[some]] | (self.doc_id[self.doc[some]] > least[node[some]])]
        edges = np.concatenate(([0], np.cumsum(self.n_words)))
        steps = np.zeros(edges[-1] + 1, dtype=np.int64)
        begin = edges[self.doc[hit]] + self.at[hit]
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + self.window, -1)
        covered = np.cumsum(steps)[:-1] > 0
        return np.split(covered, edges[1:-1]) if len(self.n_words) else []


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes, those that are all zero left out."""
    import zstandard

    octets = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    n = -(-int(np.bitwise_or.reduce(values, initial=0)).bit_length() // 8)
    return bytes([n]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(octets[:, :n].T).tobytes())


def swell(body: bytes, n: int) -> np.ndarray:
    import zstandard

    out = np.zeros((n, 8), dtype=np.uint8)
    if body[0]:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8).reshape(body[0], n)
        out[:, : body[0]] = planes.T
    return out.view("<u8").reshape(-1)


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=_U(0))


def _slices(group: np.ndarray):
    """(group, from, to) of each run of a sorted array."""
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else []
    return [(int(group[a]), int(a), int(b)) for a, b in zip(begin, [*begin[1:], len(group)])]


def _rows(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = zip(*rows) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [squeeze(a) for a in arrays]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack(body: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 4], "little")
        out.append(swell(body[at + 4 : at + 4 + size], n))
        at += 4 + size
    return out


def _bits(*flags: np.ndarray) -> bytes:
    return np.packbits(np.concatenate(flags)).tobytes()


def _answers(table, step: int, n: int) -> list[np.ndarray]:
    """The answers to what was asked in ascending order of groups, each flag in one array of n."""
    found: dict[int, tuple[int, bytes]] = {}
    for s, bucket, k, body in zip(*[table.column(c).to_pylist() for c in ("step", "bucket", "n", "body")]):
        if s == step:
            found[bucket] = (k, body)
    parts = [(k, np.unpackbits(np.frombuffer(found[b][1], np.uint8)).astype(bool)) for b in sorted(found) for k in [found[b][0]]]
    flags = 2 if step == 1 else 1
    out = [np.concatenate([bits[f * k : (f + 1) * k] for k, bits in parts]) if parts else np.zeros(0, bool) for f in range(flags)]
    if len(out[0]) != n:
        raise ValueError(f"{len(out[0])} answers to {n} questions")
    return out


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, shard_mb: float = SHARD_MB, common_shards: int = COMMON_SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), and the columns of carry as a struct row: kept is the words that stay, joined by one space.

    A word goes if a window of ``window`` words covers it that also starts in a document
    with a smaller doc_id. A null text has no words. Rows without a doc_id are neither
    smaller nor larger than others: they keep their words and remove none; nor do rows of
    equal doc_id remove each other's. Texts of under ``window`` words stay whole. An empty
    table gives no rows. Other columns are not read.
    """
    shards = shards_for(docs, shard_mb)
    bits = max(1, (shards - 1).bit_length())
    shift = _U(CODE_BITS - bits)
    row = F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias(unlike(list(carry))))
    dealt = docs.select("doc_id", "text", row.alias("row")).select(F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text", "row")
    dealt = dealt.repartition(shards, "shard")

    def census(table):
        shard = table.column("shard")[0].as_py()
        codes, _, _ = Shard(table, window, prefix).prefixes()
        return _rows(MESSAGE, [(b, shard, to - at, _pack(deltas(codes[at:to]))) for b, at, to in _slices((codes >> shift).astype(np.int64))])

    def count(table):
        bucket, names, sizes = table.column("bucket")[0].as_py(), table.column("shard").to_pylist(), table.column("n").to_pylist()
        lists = [np.cumsum(_unpack(b.as_py(), n)[0], dtype=_U) for b, n in zip(table.column("body"), sizes)]
        all_codes, shards_of = np.unique(np.concatenate(lists), return_counts=True)
        out = []
        for name, codes in zip(names, lists):
            n = shards_of[np.searchsorted(all_codes, codes)]
            out.append((1, name, bucket, len(codes), _bits(n > 1, n > common_shards)))
        return _rows(ANSWER, out)

    def ask(table, answers):
        if not table.num_rows:
            return _rows(MESSAGE, [])
        own = Shard(table, window, prefix)
        elsewhere, common = _answers(answers, 1, len(own.prefixes()[0]))
        group, code, locus, least, sent, _ = own.nodes(elsewhere, common, shards)
        order = np.flatnonzero(sent)
        order = order[np.argsort(group[order], kind="stable")]
        shard, out = table.column("shard")[0].as_py(), []
        for g, at, to in _slices(group[order]):
            k = order[at:to]
            out.append((g, shard, len(k), _pack(deltas(code[k]), locus[k], (least[k].view(_U) ^ _U(1 << 63)))))
        return _rows(MESSAGE, out)

    def subtree(table):
        """The group's suffixes in order of their paths; runs of equal loci are its deep nodes."""
        group, names, sizes = table.column("bucket")[0].as_py(), table.column("shard").to_pylist(), table.column("n").to_pylist()
        parts = [_unpack(b.as_py(), n) for b, n in zip(table.column("body"), sizes)]
        code = np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts])
        locus, least = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.lexsort((least, locus, code))
        depth = np.where(code[order][1:] != code[order][:-1], 0, np.where(locus[order][1:] != locus[order][:-1], prefix, window))
        node = np.concatenate(([0], np.cumsum(depth < window)))
        begin = np.concatenate(([0], np.flatnonzero(depth < window) + 1))
        smaller = np.empty(len(order), dtype=bool)
        smaller[order] = least[order] > least[order[begin]][node]
        edges = np.cumsum([0, *sizes])
        return _rows(ANSWER, [(2, name, group, n, _bits(smaller[a : a + n])) for name, n, a in zip(names, sizes, edges)])

    own_schema = "doc_id long, n_words long, n_removed long, kept string"
    result = StructType([*StructType.fromDDL(own_schema).fields, dealt.schema["row"]])

    def mark(table, answers):
        if not table.num_rows:
            return _rows(own_schema, []).append_column("row", table.column("row"))
        own = Shard(table, window, prefix)
        elsewhere, common = _answers(answers, 1, len(own.prefixes()[0]))
        group, _, _, least, sent, node = own.nodes(elsewhere, common, shards)
        order = np.flatnonzero(sent)
        order = order[np.argsort(group[order], kind="stable")]
        smaller = np.zeros(len(least), dtype=bool)
        smaller[order] = _answers(answers, 2, len(order))[0]
        out = []
        for k, covered in enumerate(own.marked(least, smaller, node)):
            words = own.bytes_of(k).split()
            n = int(covered.sum())
            if n:
                words = [words[i] for i in np.flatnonzero(~covered)]
            doc_id = table.column("doc_id")[own.rows[k]].as_py()
            out.append((doc_id, len(covered), n, b" ".join(words).decode()))
        found = _rows(own_schema, out).append_column("row", table.column("row").take(own.rows))
        tidy()
        return found

    asked = dealt.groupBy("shard").applyInArrow(census, MESSAGE)
    first = asked.groupBy("bucket").applyInArrow(count, ANSWER)
    asked = dealt.groupBy("shard").cogroup(first.groupBy("shard")).applyInArrow(ask, MESSAGE)
    second = asked.groupBy("bucket").applyInArrow(subtree, ANSWER)
    return dealt.groupBy("shard").cogroup(first.unionByName(second).groupBy("shard")).applyInArrow(mark, result)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeats taken out of text and n_chars, if there is one, counted anew; texts without a
    repeat stay as they are. Nulls, rows of equal doc_id, short texts and empty tables are as in repeats();
    other columns may have any name."""
    found = repeats(docs, carry=tuple(docs.columns))
    changed = F.col("n_removed") > 0
    own = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: The query's digest in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) u(i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM f, range(13) r(k)),
p AS (SELECT d.doc_id, u.pos, w[u.pos] AS word, c.pos IS NOT NULL AS gone FROM d, unnest(range(1, len(w) + 1)) u(pos) LEFT JOIN c ON c.doc_id = d.doc_id AND c.pos = u.pos),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
