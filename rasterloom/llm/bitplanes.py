"""Token ids as files: fixed-size blocks, transposed into bit or byte planes.

A segment holds whole documents in order. Its ids are cut into blocks of a fixed
number; each block is transposed into planes (bit k, or byte k, of every id), each
plane is compressed with zstandard on its own, and a chunk index at the end names
the place of every plane, so that a reader can fetch one block or a few planes.

Segment, little-endian::

    magic "TOKPLN01", u32 bytes of the head, head (JSON), documents, chunks, index,
    u64 bytes of the index, magic "TOKPLNIX"

``documents`` is a zstandard frame of the doc_ids (i64), their validity (u8) and
their lengths (u32). The index has (u64 place, u32 bytes) for each block and plane.

Files are written by Spark's text sink, one row for a segment: it writes a value's
bytes as they are, and its line feed after each segment is part of the format. So
files go wherever Spark can write, with Spark's commit protocol behind them.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm import tokens
from rasterloom.llm.common import prefer_names, shards_for, work_path, written

MAGIC, TAIL = b"TOKPLN01", b"TOKPLNIX"
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 2_000_000
LEVEL = 3
ROWS = "part int, in_part long, doc_id long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Only as many planes as the largest id needs; one at least."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    if planes == "bit":
        return [np.packbits((ids >> np.uint32(k)) & np.uint32(1), bitorder="little").tobytes() for k in range(bits)]
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [octets[:, k].tobytes() for k in range(-(-bits // 8))]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint32)
    for k, part in enumerate(parts):
        raw = np.frombuffer(part, dtype=np.uint8)
        if planes == "bit":
            out |= np.unpackbits(raw, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
        else:
            out |= raw.astype(np.uint32) << np.uint32(8 * k)
    return out


def segment(docs: list[tuple[int | None, bytes]], head: dict, planes: str, block_ids: int) -> bytes:
    """docs: (doc_id, ids as little-endian unsigned 32-bit integers)."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    ids = np.frombuffer(b"".join(d for _, d in docs), dtype="<u4")
    table = (
        np.array([0 if i is None else i for i, _ in docs], dtype="<i8").tobytes()
        + np.array([i is not None for i, _ in docs], dtype=np.uint8).tobytes()
        + np.array([len(d) // 4 for _, d in docs], dtype="<u4").tobytes()
    )
    table = squeeze(table)
    chunks, index, blocks = [], [], []
    place = 0
    for at in range(0, len(ids), block_ids):
        parts = to_planes(ids[at : at + block_ids], planes)
        blocks.append(len(parts))
        for part in map(squeeze, parts):
            index.append(struct.pack("<QI", place, len(part)))
            chunks.append(part)
            place += len(part)
    head = head | {"planes": planes, "block_ids": block_ids, "n_docs": len(docs), "n_ids": len(ids), "table": len(table), "chunks": place, "planes_of": blocks}
    top, tail = json.dumps(head).encode(), b"".join(index)
    return b"".join([MAGIC, struct.pack("<I", len(top)), top, table, *chunks, tail, struct.pack("<Q", len(tail)), TAIL])


def read_segments(content: bytes) -> Iterator[tuple[dict, list[int | None], np.ndarray, np.ndarray]]:
    """(head, doc_ids, lengths, ids) of each segment of a file."""
    import zstandard

    view, at = memoryview(content), 0
    swell = zstandard.ZstdDecompressor().decompress
    while at < len(view):
        if view[at : at + 8] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        (n,) = struct.unpack_from("<I", view, at + 8)
        head = json.loads(bytes(view[at + 12 : at + 12 + n]))
        at += 12 + n
        table, k = swell(view[at : at + head["table"]]), head["n_docs"]
        doc_ids, valid = np.frombuffer(table, "<i8", k), np.frombuffer(table, np.uint8, k, 8 * k)
        lengths = np.frombuffer(table, "<u4", k, 9 * k)
        at += head["table"]
        base, at = at, at + head["chunks"]
        index = [struct.unpack_from("<QI", view, at + 12 * i) for i in range(sum(head["planes_of"]))]
        at += 12 * len(index)
        if struct.unpack_from("<Q", view, at)[0] != 12 * len(index) or view[at + 8 : at + 16] != TAIL or view[at + 16 : at + 17] != b"\n":
            raise ValueError(f"segment is not closed at byte {at}")
        at += 17
        ids, done, entry = np.zeros(head["n_ids"], dtype=np.uint32), 0, iter(index)
        for count in head["planes_of"]:
            size = min(head["block_ids"], len(ids) - done)
            parts = [swell(view[base + p : base + p + m]) for p, m in (next(entry) for _ in range(count))]
            ids[done : done + size] = from_planes(parts, size, head["planes"])
            done += size
        yield head, [int(i) if v else None for i, v in zip(doc_ids, valid)], lengths, ids


def write_ids(docs: DataFrame, vocabulary: str, path: str, kind: str = "word", planes: str = "byte", block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, shard_mb: float = 12) -> None:
    """Encodes whole texts in ascending doc_id order and writes their ids below path.

    Texts are dealt by ranges of doc_id, so that files follow one another in that
    order and no task sees more than its range.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, at, held, docs = TaskContext.get().partitionId(), 0, 0, 0, []

        def close():
            value = segment(docs, {"part": part, "seq": seq, "first_in_part": at - held}, planes, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        for doc_id, ids in tokens.encoded_rows(batches, vocabulary, kind):
            docs.append((doc_id, ids))
            held += len(ids) // 4
            at += len(ids) // 4
            if held >= segment_ids:
                yield close()
                seq, held, docs = seq + 1, 0, []
        if docs:
            yield close()

    ranged = prefer_names(docs, "doc_id", "text")
    ranged = ranged.repartitionByRange(shards_for(docs, shard_mb), "doc_id").sortWithinPartitions("doc_id", "text")
    # A cast from binary keeps the bytes; the sink writes them and a line feed.
    ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, in_part, doc_id, n_tokens, ids_crc32) of each document in the files below path."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                for head, doc_ids, lengths, ids in read_segments(content.as_buffer()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                    cols = [np.full(len(lengths), head["part"], np.int32), head["first_in_part"] + starts, doc_ids, lengths.astype(np.int64), crc]
                    kinds = [pa.int32(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in ROWS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, ROWS)


def round_trip(docs: DataFrame, vocabulary: str, kind: str = "word", **options) -> DataFrame:
    """Writes the ids of docs and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id only; null doc_ids come first; rows of
    equal doc_id follow one another by text. An empty table gives no rows. Columns
    besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = work_path(spark, "token-ids")
    write_ids(docs, vocabulary, path, kind, **options)
    rows = written(read_ids(spark, path), "token-index")
    # One row for each file: the ids of all files before it.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
