"""Blobs as columns: inspection, band splitting, decoding and encoding of DataFrames.

Pixel tables have the columns raster_id, y, x, dim, value, valid; blob tables have blob_id
and content (and mask, where a caller brings one). Headers are read without samples, by
functions of their own, so a query that asks only for metadata never decodes. A raster is
one group: strips of bounded height (see ``rasterloom.sources.rasters``) bound it.
"""

from __future__ import annotations

import dataclasses
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rasterloom.codec import bands, writing
from rasterloom.codec.model import BlobInfo, RasterError, fail

INFO = (
    "family int, version int, data_type string, width long, height long, depth long, min_values array<double>, "
    "max_values array<double>, valid_pixel_count long, micro_block_size int, blob_size long, remaining_band_count int, "
    "max_z_error double, z_min double, z_max double, mask_encoding string, no_data_value double"
)
ERROR = "error_kind string, error_message string"
INFO_NAMES = [x.split()[0] for x in INFO.split(", ")]
PIXELS = "blob_id {id}, band int, y int, x int, dim int, value double, valid boolean"
#: Pixel rows in one Arrow batch.
CHUNK_ROWS = 200_000


def info_row(info: BlobInfo | None, error: RasterError | None = None) -> dict:
    own = {} if info is None else dataclasses.asdict(info)
    own = {k: list(v) if isinstance(v, tuple) else v for k, v in own.items()}
    return {n: own.get(n) for n in INFO_NAMES} | {"error_kind": error and error.kind, "error_message": error and error.message}


def _mask(raw) -> np.ndarray | None:
    return None if raw is None else np.frombuffer(raw, np.uint8) != 0


def _tried(what, *args) -> dict:
    try:
        return info_row(what(*args))
    except RasterError as e:
        return info_row(None, e)


def _info_udf(strict: bool, compute_range: bool):
    @pandas_udf(f"{INFO}, {ERROR}")
    def read(content: pd.Series, mask: pd.Series) -> pd.DataFrame:
        def one(data, m):
            info = bands.inspect_first(data, compute_range, _mask(m))
            return bands.strict(data, info) if strict else info

        rows = [_tried(one, c, m) if c is not None else info_row(None) for c, m in zip(content, mask)]
        return pd.DataFrame(rows, columns=[*INFO_NAMES, "error_kind", "error_message"])

    return read


def inspect(content: Column, mask: Column | None = None, strict: bool = False, compute_range: bool = True) -> Column:
    """A struct of the first blob's metadata, or of its error. strict: bytes behind it are an error."""
    return _info_udf(strict, compute_range)(content, F.lit(None).cast("binary") if mask is None else mask)


def is_first_family(content: Column) -> Column:
    return F.substring(content, 1, 9) == F.lit(bytearray(b"CntZImage"))


def is_second_family(content: Column) -> Column:
    return F.substring(content, 1, 6) == F.lit(bytearray(b"Lerc2 "))


def band_count(content: Column) -> Column:
    """A struct of the number of bands that follow one another, or of the error."""

    @pandas_udf("struct<count:int, error_kind:string, error_message:string>")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((None if c is None else bands.band_count(c), None, None))
            except RasterError as e:
                rows.append((None, e.kind, e.message))
        return pd.DataFrame(rows, columns=["count", "error_kind", "error_message"])

    return read(content)


def _id_type(blobs: DataFrame) -> str:
    return blobs.schema["blob_id"].dataType.simpleString()


def _with_mask(blobs: DataFrame) -> DataFrame:
    mask = F.col("mask") if "mask" in blobs.columns else F.lit(None).cast("binary")
    return blobs.select("blob_id", "content", mask.alias("mask"))


def split_bands(blobs: DataFrame) -> DataFrame:
    """A row for each band: blob_id, band, at (its first byte), content, band_mask (a byte a pixel, with what
    it takes over) and its metadata or the error at which the splitting ended."""
    schema = f"blob_id {_id_type(blobs)}, band int, at long, content binary, band_mask binary, {INFO}, {ERROR}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for blob_id, content, mask in frame.itertuples(index=False):
                n = -1
                if content is None:
                    rows.append({"blob_id": blob_id, "band": 0, "at": None, "content": None, "band_mask": None} | info_row(None))
                    continue
                try:
                    for n, b in enumerate(bands.each(content, _mask(mask), samples=False)):
                        own = None if b.mask is None else b.mask.astype(np.uint8).tobytes()
                        rows.append({"blob_id": blob_id, "band": n, "at": b.at, "content": content[b.at : b.at + b.info.blob_size], "band_mask": own} | info_row(b.info))
                except RasterError as e:
                    rows.append({"blob_id": blob_id, "band": n + 1, "at": None, "content": None, "band_mask": None} | info_row(None, e))
            yield pd.DataFrame(rows, columns=["blob_id", "band", "at", "content", "band_mask", *INFO_NAMES, "error_kind", "error_message"])

    return _with_mask(blobs).mapInPandas(run, schema)


def decode(blobs: DataFrame, strict: bool = True) -> DataFrame:
    """blob_id, values (in order of row, column, dimension), valid (a byte a pixel, or null) and
    metadata or error, a row for each blob (all null for a null one). strict: bytes behind it are an error."""
    schema = f"blob_id {_id_type(blobs)}, values array<double>, valid binary, {INFO}, {ERROR}"

    def run(frames):
        for frame in frames:
            rows = []
            for blob_id, content, mask in frame.itertuples(index=False):
                if content is None:
                    rows.append({"blob_id": blob_id, "values": None, "valid": None} | info_row(None))
                    continue
                try:
                    b = (bands.decode if strict else bands.decode_first)(content, _mask(mask))
                    own = None if b.mask is None else b.mask.astype(np.uint8).tobytes()
                    rows.append({"blob_id": blob_id, "values": b.values.reshape(-1), "valid": own} | info_row(b.info))
                except RasterError as e:
                    rows.append({"blob_id": blob_id, "values": None, "valid": None} | info_row(None, e))
            yield pd.DataFrame(rows, columns=["blob_id", "values", "valid", *INFO_NAMES, "error_kind", "error_message"])

    return _with_mask(blobs).mapInPandas(run, schema)


#: Spark's type for each sample type: unsigned ones take the next larger.
NATIVE = {"i8": "tinyint", "u8": "smallint", "i16": "smallint", "u16": "int", "i32": "int", "u32": "bigint", "f32": "float", "f64": "double"}


def decode_native(blobs: DataFrame, data_type: str, permissive: bool = False) -> DataFrame:
    """blob_id, shape (rows, columns and, if above 1, depth) and samples in the blob's own type, which
    must be data_type, a row for each blob; all null for a null blob. An error ends the task with it;
    permissive: a blob with an error, or of another type, is all null, and bytes behind a blob are left."""

    def run(frames):
        for frame in frames:
            rows = []
            for blob_id, content, mask in frame.itertuples(index=False):
                try:
                    own = None if content is None else bands.typed((bands.decode_first if permissive else bands.decode)(content, _mask(mask)), data_type)
                except RasterError:
                    if not permissive:
                        raise
                    own = None
                rows.append((blob_id, None, None) if own is None else (blob_id, list(own.shape), own.reshape(-1)))
            yield pd.DataFrame(rows, columns=["blob_id", "shape", "samples"])

    return _with_mask(blobs).mapInPandas(run, f"blob_id {_id_type(blobs)}, shape array<int>, samples array<{NATIVE[data_type]}>")


def mask_bytes(content: Column | str) -> Column:
    """The mask of each blob, a byte a pixel, without decoding a sample; null for no mask or no blob."""

    @pandas_udf("binary")
    def read(contents: pd.Series) -> pd.Series:
        def one(data):
            found = None if data is None else bands.decode_mask(data)
            return None if found is None else found.astype(np.uint8).tobytes()

        return contents.map(one)

    return read(content)


def set_masks(blobs: DataFrame) -> DataFrame:
    """blob_id, shape (rows, columns and, if above 1, bands) and masks (a byte a pixel and band, bands last) of each set of
    bands, from headers and masks alone: no sample is decoded.

    Masks that are taken over are there; a band without a mask is all ones; both are null where no band has a mask, and
    for a null blob. An error, or bands that are no set, end the task with it.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for blob_id, content, mask in frame.itertuples(index=False):
                found = [] if content is None else list(bands.each(content, _mask(mask), samples=False))
                if content is not None:
                    bands.check([b.info for b in found])
                masks = bands.band_masks(found)
                rows.append((blob_id, None, None) if masks is None else (blob_id, list(masks.shape), masks.tobytes()))
            yield pd.DataFrame(rows, columns=["blob_id", "shape", "masks"])

    return _with_mask(blobs).mapInPandas(run, f"blob_id {_id_type(blobs)}, shape array<int>, masks binary")


def frame_lengths(blobs: DataFrame, content: str = "content") -> DataFrame:
    """blob_id, frame, n_bytes: the blobs of each byte stream, one after the other, each by its own header.
    An end within a blob ends the task with Truncated; a null or empty stream has no rows."""

    def run(frames):
        for frame in frames:
            rows = [(i, k, len(f)) for i, data in frame.itertuples(index=False) if data is not None for k, f in enumerate(bands.frames(io.BytesIO(data)))]
            yield pd.DataFrame(rows, columns=["blob_id", "frame", "n_bytes"])

    return blobs.select("blob_id", content).mapInPandas(run, f"blob_id {_id_type(blobs)}, frame int, n_bytes long")


def _samples(blob_id, id_type, band: int, b: bands.Band) -> Iterator:
    """Record batches of a row for each sample of one band."""
    import pyarrow as pa

    h, w, depth = b.values.shape
    y, x, d = np.indices((h, w, depth), dtype=np.int32).reshape(3, -1)
    ok = np.repeat(np.ones(h * w, bool) if b.mask is None else b.mask, depth)
    values = b.values.reshape(-1)
    for at in range(0, len(values), CHUNK_ROWS):
        part = slice(at, at + CHUNK_ROWS)
        n = len(values[part])
        cols = [pa.array([blob_id] * n, id_type), pa.array(np.full(n, band, np.int32)), y[part], x[part], d[part], values[part], ok[part]]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["blob_id", "band", "y", "x", "dim", "value", "valid"])


def pixels(blobs: DataFrame, permissive: bool = False) -> DataFrame:
    """A row for each sample of each band; invalid pixels have value 0. A null blob has no rows.
    An error ends the task with it; permissive: a blob with an error has no rows."""

    def run(batches):
        for batch in batches:
            for blob_id, content, mask in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    found = [] if content is None else bands.decode_set(content, _mask(mask))
                except RasterError:
                    if not permissive:
                        raise
                    found = []
                for band, b in enumerate(found):
                    yield from _samples(blob_id, batch.schema.field(0).type, band, b)

    return _with_mask(blobs).mapInArrow(run, PIXELS.format(id=_id_type(blobs)))


def pixels_by_band(blobs: DataFrame) -> DataFrame:
    """As pixels(), with the bands of a set decoded side by side: headers and masks are read where the set is,
    then each band, still compressed, goes to a task with the mask that it takes over."""
    schema = f"blob_id {_id_type(blobs)}, band int, content binary, mask binary"

    def cut(frames):
        for frame in frames:
            rows = []
            for blob_id, content, mask in frame.itertuples(index=False):
                if content is None:
                    continue
                carried, infos = _mask(mask), []
                for n, b in enumerate(bands.each(content, carried, samples=False)):
                    own = None if b.mask is None else b.mask.astype(np.uint8).tobytes()
                    rows.append((blob_id, n, content[b.at : b.at + b.info.blob_size], own))
                    infos.append(b.info)
                bands.check(infos)
            yield pd.DataFrame(rows, columns=["blob_id", "band", "content", "mask"])

    def run(batches):
        for batch in batches:
            for blob_id, band, content, mask in zip(*[c.to_pylist() for c in batch.columns]):
                yield from _samples(blob_id, batch.schema.field(0).type, band, bands.decode(content, _mask(mask)))

    return _with_mask(blobs).mapInPandas(cut, schema).repartition("blob_id", "band").mapInArrow(run, PIXELS.format(id=_id_type(blobs)))


def decode_stacked(blobs: DataFrame, data_type: str, layout: str = "interleaved") -> DataFrame:
    """blob_id, shape, samples, masks: all bands of a set as one array in the blobs' own type data_type, or f64.

    shape is rows, columns, bands (interleaved) or bands, rows, columns (bsq), then depth if above 1;
    one band alone has no axis of bands. masks is a byte a pixel and band, bands last, or null if no
    band has a mask. All null for a null blob. An error ends the task with it.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for blob_id, content, mask in frame.itertuples(index=False):
                if content is None:
                    rows.append((blob_id, None, None, None))
                    continue
                found = bands.decode_set(content, _mask(mask))
                own, masks = bands.stacked(found, layout, data_type), bands.band_masks(found)
                rows.append((blob_id, list(own.shape), own.reshape(-1), None if masks is None else masks.tobytes()))
            yield pd.DataFrame(rows, columns=["blob_id", "shape", "samples", "masks"])

    return _with_mask(blobs).mapInPandas(run, f"blob_id {_id_type(blobs)}, shape array<int>, samples array<{NATIVE[data_type]}>, masks binary")


def grid_of(frame: pd.DataFrame, shape: tuple[int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values (height, width, depth), mask (height, width)) of one raster's pixel rows; places without a
    row are invalid, and two rows for a place are an error. shape: if not what the largest indices give."""
    h, w, depth = shape or shape_of(frame)
    values, valid = np.zeros((h, w, depth)), np.zeros((h, w, depth), bool)
    at = frame["y"].to_numpy(), frame["x"].to_numpy(), frame["dim"].to_numpy()
    if len(np.unique(np.ravel_multi_index(at, (h, w, depth)))) < len(frame):
        fail("InvalidArgument", "a place of a raster has more than one row")
    ok = frame["valid"].to_numpy(dtype=bool) & frame["value"].notna().to_numpy()
    values[at] = np.where(ok, frame["value"].to_numpy(dtype=float), 0.0)
    valid[at] = ok
    return values, valid.all(axis=2)


def shape_of(frame: pd.DataFrame) -> tuple[int, int, int]:
    return tuple(int(frame[c].max()) + 1 for c in ("y", "x", "dim"))


def encode(rows: DataFrame, data_type: str, options: writing.Options = writing.Options()) -> DataFrame:
    """blob_id, content: a blob for each raster_id of a pixel table. A mask is stored if a pixel is invalid."""
    kind = rows.schema["raster_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values, mask = grid_of(frame)
        blob = writing.encode(values, data_type, None if mask.all() else mask, options)
        return pd.DataFrame({"blob_id": [frame["raster_id"].iloc[0]], "content": [blob]})

    return rows.select("raster_id", "y", "x", "dim", "value", "valid").groupBy("raster_id").applyInPandas(run, f"blob_id {kind}, content binary")


def _prepared(frame: pd.DataFrame, data_type: str, options: writing.Options) -> list[writing.Prepared]:
    """The bands of one raster as the writer would store them."""
    shape = shape_of(frame)
    parts = [grid_of(part, shape) for _, part in frame.groupby("band", sort=True)]
    first = parts[0][1]
    if all(np.array_equal(m, first) for _, m in parts):
        return writing.prepare_bands([v for v, _ in parts], data_type, None if first.all() else first, options)
    return [writing.prepare(v, data_type, m, options) for v, m in parts]


def encode_bands(rows: DataFrame, data_type: str, options: writing.Options = writing.Options()) -> DataFrame:
    """blob_id, content: the bands (column band) of each raster_id as blobs that follow one another.

    All bands of a raster have the extent of the largest. One mask for all is stored with the first
    band and taken over by the rest, unless no-data takes pixels out of a band; else each has its own.
    """
    kind = rows.schema["raster_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = _prepared(frame, data_type, options)
        blob = b"".join(writing.blob(p, options.profile == "strict", len(found) - 1 - i) for i, p in enumerate(found))
        return pd.DataFrame({"blob_id": [frame["raster_id"].iloc[0]], "content": [blob]})

    return rows.select("raster_id", "band", "y", "x", "dim", "value", "valid").groupBy("raster_id").applyInPandas(run, f"blob_id {kind}, content binary")


def encoded_sizes(rows: DataFrame, data_type: str, options: writing.Options = writing.Options()) -> DataFrame:
    """raster_id, n_bytes: the exact size of what encode_bands() makes of each raster, or encode() of rows
    without a column band, from the choices of the writer alone; only masks are coded."""
    kind = rows.schema["raster_id"].dataType.simpleString()
    rows = rows if "band" in rows.columns else rows.withColumn("band", F.lit(0))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = sum(writing.size_of(p, options.profile == "strict") for p in _prepared(frame, data_type, options))
        return pd.DataFrame({"raster_id": [frame["raster_id"].iloc[0]], "n_bytes": [n]})

    return rows.select("raster_id", "band", "y", "x", "dim", "value", "valid").groupBy("raster_id").applyInPandas(run, f"raster_id {kind}, n_bytes long")
