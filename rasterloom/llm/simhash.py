"""Near-duplicate groups by SimHash fingerprints.

Fingerprints of 64 bits are linked at ``max_bits`` (3) or fewer differing bits, so of
their 8 bytes at least 5 are equal at the same position: the guaranteed minimum.

The inverted index has a list for each set of four positions with their four bytes.
The 14 sets are the blocks of the Steiner system S(3, 4, 8): whichever three positions
differ lie in a block, and its complement, a block too, is equal. So each link meets in
a list, and lists are told apart by 32 bits, not by the 8 of a single byte. Within a list
the shared positional bytes of each pair are tallied; pairs of fewer than the minimum
(those that share the list's four bytes alone) are dropped, and only the retained ones are
verified on their bits.

Only distinct fingerprints are indexed. A list yields edges that join its links, a few for
each entry at most, whatever the number of links. Lists over ``list_limit`` entries are
split by a fifth byte, of which four linked entries share at least one. What is still large
is split in memory by parts of the bits that differ in it: of ``max_bits`` + 1 parts, two
linked entries agree in one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import prefer_names, text_hash, tidy, unlike, written
from rasterloom.llm.components import connected_components

SEED, SHINGLE, MAX_BITS, LIST_LIMIT = 42, 3, 3, 50_000
#: So many entries of a list are compared directly.
DIRECT = 2000
#: The 14 blocks of S(3, 4, 8), as positions of bytes.
BLOCKS = [
    (0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 1, 6, 7), (2, 3, 4, 5), (0, 2, 4, 6),
    (1, 3, 5, 7), (0, 2, 5, 7), (1, 3, 4, 6), (0, 3, 4, 7), (1, 2, 5, 6), (0, 3, 5, 6), (1, 2, 4, 7),
]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(octets), 1 << 16):
        ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed long. A null text has no words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "text_hash", "fp"])
        tidy()

    docs = prefer_names(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text_hash": text_hash()})
    return docs.mapInArrow(run, "doc_id long, text_hash long, fp long")


def byte(at: int):
    return F.shiftrightunsigned("fp", 8 * at).bitwiseAND(F.lit(255))


def differing_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes of each xor are not zero."""
    x = x | x >> np.uint64(4)
    x = x | x >> np.uint64(2)
    x = x | x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x0101010101010101))


def retained(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the xors whose pairs share as many positional bytes as a link must."""
    return np.flatnonzero(8 - differing_bytes(x) >= 8 - max_bits)


def linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the xors of linked pairs: tallied, and those retained verified on their bits."""
    at = retained(x, max_bits)
    return at[np.bitwise_count(x[at]) <= max_bits]


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join what is linked, directly or through others, in one list.

    An entry that has been reached is not compared again with others reached, so groups
    of like entries, however large, cost little more than their size. Over DIRECT entries
    are split by parts of the bits that differ among them: links agree in a part.
    """
    rest, edges = np.unique(fps), []
    if len(rest) > DIRECT:
        differ = int(np.bitwise_or.reduce(rest ^ rest[0]))
        bits = [b for b in range(64) if differ >> b & 1]
        for part in np.array_split(np.array(bits, dtype=np.uint64), max_bits + 1):
            keys = rest & np.uint64(sum(1 << int(b) for b in part))
            order = np.argsort(keys, kind="stable")
            for group in np.split(rest[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if len(group) > 1:
                    edges.extend(forest(group, max_bits))
        return edges
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            hit = linked(rest ^ at, max_bits)
            if len(hit):
                new = rest[hit]
                edges.append((np.full(len(new), at), new))
                reached.extend(new)
                rest = np.delete(rest, hit)
    return edges


def links(fps: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints of fps as their links do."""
    if max_bits > 3:
        raise ValueError("the index finds links of at most 3 bits")

    def key(block: int, fifth: int | None = None):
        positions = BLOCKS[block] if fifth is None else (*BLOCKS[block], fifth)
        value = F.lit(block * 9 + (8 if fifth is None else fifth)).cast("long")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(byte(p))
        return value

    lists = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), key(i).alias("key")) for i in range(len(BLOCKS))])).alias("x")).select("fp", "x.*")
    lists = written(lists, "lists")
    counts = lists.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = lists.join(counts.select("key", "n"), "key")  # lists of one entry go
    split = F.lit(None).cast("array<bigint>")
    for i, block in enumerate(BLOCKS):
        split = F.when(F.col("block") == i, F.array(*[key(i, p) for p in range(8) if p not in block])).otherwise(split)
    keys = F.when(F.col("n") > list_limit, split).otherwise(F.array("key"))
    lists = lists.select("fp", F.explode(keys).alias("key"))

    def run(batches):
        import pyarrow as pa

        def edges_of(keys, fps):
            order = np.lexsort((fps, keys))
            keys, fps = keys[order], fps[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            two = first[size == 2]
            found = [(fps[two], fps[two + 1])]
            found[0] = tuple(x[linked(found[0][0] ^ found[0][1], max_bits)] for x in found[0])
            for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                found.extend(forest(fps[at : at + n], max_bits))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found)], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:  # sorted by key: all but the last list of what is held are whole
            keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if held and keys[0] == held[0][0][0] == keys[-1]:
                held.append((keys, fps))
                continue
            keys = np.concatenate([*[h[0] for h in held], keys])
            fps = np.concatenate([*[h[1] for h in held], fps])
            cut = int(np.searchsorted(keys, keys[-1]))
            held = [(keys[cut:], fps[cut:])]
            if cut:
                yield edges_of(keys[:cut], fps[:cut])
        if held:
            yield edges_of(*[np.concatenate(x) for x in zip(*held)])

    return lists.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row; component_id is the least doc_id reachable.

    Texts without words have fingerprint zero and are linked like any other. Rows of
    equal doc_id are each judged by their own text; a null doc_id is never the least one
    (a group of nulls only has a null component_id). An empty table gives no rows; other
    columns are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs with the least doc_id of their group, unchanged.

    In a group where no row has a doc_id, all stay; so do rows that repeat the one that stays.
    Null and empty texts are alike, and a group like any other. An empty table gives no rows;
    other columns may have any name.
    """
    own_id, own_hash = unlike(docs.columns, "kept_id"), unlike(docs.columns, "kept_hash")
    kept = groups(docs, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_hash() == F.col(own_hash)), "left_semi")
