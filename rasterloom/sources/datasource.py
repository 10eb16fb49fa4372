"""The data source "rasterloom": blobs in files as tables, for batch and streaming reads.

    spark.dataSource.register(RasterSource)
    spark.read.format("rasterloom").option("pixels", "false").load(path)

Rows are bands. Files are read in byte ranges of whole blobs, of about equal bytes: one file of
many blobs is many tasks, and small files share one. A reader that isn't asked for pixels reads
headers and masks only. With the option pushFilters, which needs the session's setting
``spark.sql.python.filterPushdown.enabled``, comparisons of metadata columns with a literal
are taken over and prune before decoding.

Paths are those that the reading process can open: a local or mounted folder. For other
stores, read with ``binaryFile`` and use ``rasterloom.functions.blobs`` on the content.

Options: pixels (default true), mode (PERMISSIVE: an error is a row; FAILFAST: it is raised;
DROPMALFORMED: it is left out), maxBlobBytes, splitBytes (most bytes of a partition, default 32 MB),
minPartitions (default 16: so many at least, where there are as many blobs), index (a saved index of
blobs), log (of a stream: where it notes which files it has seen).
"""

from __future__ import annotations

import glob
import json
import operator
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rasterloom.codec import bands, reading
from rasterloom.codec.model import RasterError
from rasterloom.functions.blobs import ERROR, INFO, INFO_NAMES, info_row
from rasterloom.sources import ranges

SCHEMA = f"path string, band int, {INFO}, {ERROR}, mask binary, values array<double>"
SPLIT_BYTES, LEAST_PARTS, MOST_BYTES = 32 << 20, 16, 512 << 20
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class Part(InputPartition):
    def __init__(self, of: list[ranges.Range]):
        self.of = of


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f) and not any(p.startswith(("_", ".")) for p in os.path.relpath(f, path).split(os.sep)))
    return sorted(glob.glob(path))


def _option(options: dict, name: str, default):
    """Spark hands names in lower case, callers as they write them."""
    return type(default)(options.get(name.lower(), options.get(name, default)))


def rows_of(part: ranges.Range, options: dict, filters=()) -> Iterator[tuple]:
    """A row for each band of a byte range, and one for the error at which it ends."""
    mode, pixels = options.get("mode", "PERMISSIVE").upper(), str(options.get("pixels", "true")).lower() == "true"

    def fits(row: dict) -> bool:
        return all(row[c] is not None and _COMPARE[type(f)](row[c], f.value) for f in filters for c in [f.attribute[0]])

    band = part.band - 1
    try:
        if not part.length:
            raise RasterError("InvalidBlob", "band set is empty")
        if part.over:
            raise RasterError("InvalidBlob", "the blob is over maxBlobBytes")
        data, before = ranges.read(part)
        mask = reading.inspect(before, False, want_mask=True)[1] if before else None
        wanted = [i for i, b in enumerate(bands.each(data, mask, samples=False)) if fits(info_row(b.info))] if filters else None
        if wanted == []:
            return
        for band, b in enumerate(bands.each(data, mask, samples=pixels), part.band):
            row = info_row(b.info)
            if fits(row):
                own = None if b.mask is None else b.mask.astype(np.uint8).tobytes()
                yield (part.path, band, *[row[n] for n in INFO_NAMES], None, None, own, b.values.reshape(-1).tolist() if pixels else None)
    except RasterError as e:
        if mode == "FAILFAST":
            raise
        if mode == "PERMISSIVE":
            yield (part.path, band + 1, *[None] * len(INFO_NAMES), e.kind, e.message, None, None)


def parts_of(files: list[str], options: dict) -> list[Part]:
    """Partitions of about equal bytes. Files that an index (option index: a folder of Parquet, as ranges.index()
    makes it) has are taken from there; the headers of others are hopped over here."""
    known: dict[str, list[ranges.Entry]] = {}
    if options.get("index"):
        import pyarrow.dataset as ds

        wanted = set(files)
        for batch in ds.dataset(options["index"].removeprefix("file://"), format="parquet", exclude_invalid_files=True).to_batches():
            for row in batch.to_pylist():
                path = row["path"].removeprefix("file:")
                if path in wanted:
                    known.setdefault(path, []).append(ranges.Entry(**row | {"path": path}))
    entries = []
    for f in files:
        found = sorted(known[f], key=lambda e: e.at) if f in known else list(ranges.hop(f))
        entries += found or [ranges.Entry(f, 0, 0, 0)]
    return [Part(g) for g in ranges.balanced(entries, _option(options, "splitBytes", SPLIT_BYTES), _option(options, "minPartitions", LEAST_PARTS), _option(options, "maxBlobBytes", MOST_BYTES))]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = options, []

    def partitions(self):
        return parts_of(_files(self.options["path"]), self.options) or [Part([])]

    def read(self, partition):
        for r in partition.of:
            yield from rows_of(r, self.options, self.filters)


class FilteringReader(Reader):
    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in INFO_NAMES:
                self.filters.append(f)
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    """Each micro-batch reads the files that no batch before it had, in byte ranges as a batch read does.

    New files are added to a log (option log; else the folder _rasterloom_log below the path): entry k names those
    that were first seen in the k-th place. The offset is a place in that log, so it doesn't grow, and a
    batch that is planned again after a failure has the same files. A file that comes late is read, whatever
    its name or time.
    """

    def __init__(self, options: dict):
        self.options = options
        self.log = (options.get("log") or f"{options['path'].rstrip('/')}/_rasterloom_log").removeprefix("file://")
        self.seen, self.place = set(), 0

    def _entry(self, place: int) -> str:
        return f"{self.log}/{place:012d}.json"

    def _catch_up(self) -> None:
        while os.path.exists(self._entry(self.place + 1)):
            self.place += 1
            with open(self._entry(self.place), encoding="utf-8") as f:
                self.seen.update(json.load(f))

    def initialOffset(self):
        return {"place": 0}

    def latestOffset(self):
        self._catch_up()
        new = [f for f in _files(self.options["path"]) if f not in self.seen]
        if new:
            os.makedirs(self.log, exist_ok=True)
            draft = f"{self.log}/.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(new, f)
            os.link(draft, self._entry(self.place + 1))  # fails if another reader of this log was first
            os.remove(draft)
            self._catch_up()
        return {"place": self.place}

    def partitions(self, start, end):
        files = []
        for place in range(start["place"] + 1, end["place"] + 1):
            with open(self._entry(place), encoding="utf-8") as f:
                files += json.load(f)
        return parts_of(files, self.options)

    def read(self, partition):
        for r in partition.of:
            yield from rows_of(r, self.options)


class Message(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class Writer(DataSourceWriter):
    """Writes a column content as one file a row, named by blob_id (escaped, as in a URL); files appear when
    the job commits. Two rows of one blob_id are an error. Mode overwrite removes other blobs at the commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        attempt, files = TaskContext.get().taskAttemptId(), []
        for row in iterator:
            at = f"{self.path}/.{quote(str(row['blob_id']), safe='')}.{attempt}"
            if at in files:
                raise ValueError(f"two blobs are named {row['blob_id']}")
            with open(at, "wb") as f:
                f.write(row["content"])
            files.append(at)
        return Message(files)

    def commit(self, messages):
        files = [f for m in messages for f in (m.files if m else [])]
        names = [f"{os.path.basename(f)[1:].rpartition('.')[0]}.blob" for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two blobs have one name")
        for f, name in zip(files, names):
            os.replace(f, f"{self.path}/{name}")
        if self.overwrite and os.path.isdir(self.path):
            for name in set(os.listdir(self.path)) - set(names):
                if name.endswith(".blob"):
                    os.remove(f"{self.path}/{name}")

    def abort(self, messages):
        for m in messages:
            for f in m.files if m else []:
                if os.path.exists(f):
                    os.remove(f)


class RasterSource(DataSource):
    @classmethod
    def name(cls):
        return "rasterloom"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = dict(self.options)
        return (FilteringReader if options.get("pushfilters", options.get("pushFilters", "false")).lower() == "true" else Reader)(options)

    def streamReader(self, schema):
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)

