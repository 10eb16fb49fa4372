"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (projections and
attention within the document). Documents are cut into whole sequences first.
The rests, in descending cost, each go to the sequence of lowest cost that has
room; one that fits nowhere is cut to fill the cheapest sequence with any room,
and its rest goes on. A group of rests gets exactly as many sequences as its
tokens need, so that less than one sequence of padding remains in each group.

Groups are runs of a partition's documents in order of doc_id and text, closed at
``group_tokens``: nothing is shuffled, a task keeps only one group in memory, and a task
that is run again gives the same rows, in whatever order a shuffle brings its input.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from rasterloom.llm import tokens
from rasterloom.llm.common import prefer_names, text_hash

CAPACITY = 2048
GROUP_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Cost:
    """Cost of a token, and of a pair of tokens: at 2048 tokens the two parts are alike."""

    linear: float = 1.0
    quadratic: float = 1.0 / 2048

    def of(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


def assign(lengths: list[int], capacity: int = CAPACITY, cost: Cost = Cost()) -> list[tuple[int, int, int, int, int]]:
    """(index, start within it, length, sequence, offset) for lengths of at most capacity.

    Zero lengths get no piece. Ties go by index, then to the lowest sequence, so the result is fixed.
    """
    total = sum(lengths)
    if not total:
        return []
    load = np.zeros(-(-total // capacity))
    room = np.full(len(load), capacity, dtype=np.int64)
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            s = int(np.argmin(np.where(room >= left, load, np.inf)))
            if room[s] < left:  # it fits nowhere: fill the cheapest with any room
                s = int(np.argmin(np.where(room > 0, load, np.inf)))
            n = min(left, int(room[s]))
            out.append((i, start, n, s, capacity - int(room[s])))
            room[s] -= n
            load[s] += cost.of(n)
            start, left = start + n, left - n
    return out


class _Group:
    def __init__(self, first_sequence: int, capacity: int, cost: Cost):
        self.sequence, self.capacity, self.cost = first_sequence, capacity, cost
        self.rests: list[tuple[int | None, int, bytes, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes):
        n, whole = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + self.capacity)])
            yield doc_id, start, self.capacity, crc, n, self.sequence, 0
            self.sequence += 1
        if n > whole:
            self.rests.append((doc_id, whole, ids[4 * whole :], n))
            self.tokens += n - whole

    def close(self):
        last = -1
        for i, at, n, s, offset in assign([len(r[2]) // 4 for r in self.rests], self.capacity, self.cost):
            doc_id, start, ids, total = self.rests[i]
            yield doc_id, start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, self.sequence + s, offset
            last = max(last, s)
        self.sequence, self.rests, self.tokens = self.sequence + last + 1, [], 0


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, cost: Cost = Cost()) -> DataFrame:
    """A row for each piece of each document's ids (with the end id).

    Null or empty texts have the end id only. Rows with equal or null doc_id are
    packed each on its own. An empty table gives no rows. Columns besides doc_id
    and text are not read. sequence_id is the partition times 2**32 plus a count.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        group = _Group(TaskContext.get().partitionId() << 32, capacity, cost)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def flush():
            cols = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for doc_id, ids in tokens.encoded_rows(batches, vocabulary, "byte"):
            rows.extend(group.add(doc_id, ids))
            if group.tokens >= group_tokens:
                rows.extend(group.close())
            if len(rows) > 20_000:
                yield flush()
                rows.clear()
        rows.extend(group.close())
        if rows:
            yield flush()

    return prefer_names(docs, "doc_id", "text").sortWithinPartitions("doc_id", text_hash()).mapInArrow(run, SCHEMA)
