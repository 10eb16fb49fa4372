"""WARC archives with revisit records for payloads that are already there.

Only headers (page_id, digest, size) are shuffled by payload digest to choose each
payload's original response. Payloads are dealt once, by page_id and digest (which no
hot payload skews), to meet the decision, and a revisit's payload is dropped there.

A record is rendered by JVM expressions and written by Spark's text sink, whose line
separator is set to the two line ends that close a WARC record; so archives go wherever
Spark can write. They are read as whole files, whose size the number of archives bounds,
and parsed by their declared lengths.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import prefer_names, shards_for, work_path, written

MIN_BYTES = 100
ARCHIVE_MB = 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, refers_to long, uri string, payload_digest string, payload_bytes long, payload binary"


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), payload_digest, payload_bytes."""
    pages = prefer_names(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))


def decide(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, payload_digest, original): original is the response that a record revisits, or null."""
    heads = heads.select("page_id", "payload_digest", "payload_bytes").distinct()
    firsts = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = heads.join(firsts.select("payload_digest", "first"), "payload_digest", "left")
    return found.select("page_id", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("original"))


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def render(records: DataFrame, date: str) -> Column:
    """A record without the line ends that close it."""
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    # No byte of a URL may end its line.
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("original"), F.col("payload_digest")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-Id", F.col("original").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_mb: float = ARCHIVE_MB, date: str | None = None) -> None:
    """Writes a record for each row of pages below path.

    Of records with equal payloads of at least min_bytes, that with the smallest page_id
    is the response and the others revisit it. Null payloads are empty. A null page_id is
    never the smallest, unless all are null: then all are responses. Rows of equal page_id
    and payload are each written, with the same type. A null url has no target URI. An
    empty table gives no records.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = with_digest(pages)
    # One key that is never null, so that the join takes the payloads as they are dealt.
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "payload_digest")
    originals = decide(full, min_bytes).select(key.alias("key"), "original")
    dealt = full.withColumn("key", key).repartition(shards_for(pages, archive_mb, "html"), "key")
    met = dealt.join(originals, "key")
    met.select(render(met, date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(content) -> Iterator[tuple]:
    """(fields, block) of each record of an archive, gzipped or not; fields by lower-case name."""
    at, raw = 0, bytes(content)
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    view = memoryview(raw)
    while at < len(view):
        top = raw.index(b"\r\n\r\n", at)
        lines = raw[at:top].split(b"\r\n")
        if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in (x.split(b":", 1) for x in lines[1:])}
        begin, end = top + 4, top + 4 + int(fields["content-length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not closed")
        yield fields, view[begin:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below path, as in RECORD. A response's digest and size are those of what
    was read; a revisit has the digest that it names, and neither size nor payload."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: None if x is None else int(x)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parse(content.as_buffer()):
                    kind, digest, size, body = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:"), None, None
                    if kind == "response":
                        body = bytes(block).partition(b"\r\n\r\n")[2]
                        digest, size = hashlib.sha256(body).hexdigest(), len(body)
                    rows.append((number(f.get("x-page-id")), kind, number(f.get("x-refers-to-page-id")), f.get("warc-target-uri"), digest, size, body if payloads else None))
                    held += len(block)
                    if held > 16_000_000 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """records with each revisit's size from the response that it refers to.

    Revisits meet responses by page and digest. Responses have one row a key; of many
    revisits of one response, adaptive execution splits the partition.
    """
    records = records.select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes")
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'").drop("payload_bytes")
    originals = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").where("refers_to is not null").distinct()
    return responses.unionByName(revisits.join(originals, ["refers_to", "payload_digest"], "left"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written and read back."""
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    heads = written(read_archives(pages.sparkSession, path, payloads=False).drop("payload"), "warc-heads")
    return resolve(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q
"""
