"""Sample types, errors, and what a blob's header tells."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Codes of the sample types in headers.
TYPES = ("i8", "u8", "i16", "u16", "i32", "u32", "f32", "f64")
DTYPES = {"i8": "<i1", "u8": "<u1", "i16": "<i2", "u16": "<u2", "i32": "<i4", "u32": "<u4", "f32": "<f4", "f64": "<f8"}
KINDS = (
    "Truncated", "OutputTooSmall", "InvalidMagic", "UnsupportedVersion", "UnsupportedFeature", "InvalidHeader",
    "InvalidArgument", "InvalidBlob", "SizeOverflow", "AllocationFailed", "Internal", "Io", "ChecksumMismatch",
)
#: No decoded buffer may be larger.
MAX_BYTES = 512 << 20


class RasterError(ValueError):
    """kind is one of KINDS."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message


def fail(kind: str, message: str):
    raise RasterError(kind, message)


def dtype(name: str) -> np.dtype:
    return np.dtype(DTYPES[name])


def is_integer(name: str) -> bool:
    return name[0] in "iu"


def through(values: np.ndarray, name: str) -> np.ndarray:
    """float64 values as the type would hold them: toward zero, saturated, NaN to 0 for integers."""
    values = np.asarray(values, dtype=np.float64)
    if name == "f64":
        return values
    if name == "f32":
        with np.errstate(over="ignore"):
            return values.astype(np.float32).astype(np.float64)
    low, high = type_range(name)
    return np.clip(np.trunc(np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf)), low, high) + 0.0


def type_range(name: str) -> tuple[float, float]:
    limits = np.iinfo(dtype(name)) if is_integer(name) else np.finfo(dtype(name))
    return float(limits.min), float(limits.max)


def bits_required(n: int) -> int:
    return int(n).bit_length()


@dataclass(frozen=True)
class BlobInfo:
    family: int
    version: int
    data_type: str
    width: int
    height: int
    depth: int
    valid_pixel_count: int
    micro_block_size: int
    blob_size: int
    max_z_error: float
    z_min: float
    z_max: float
    mask_encoding: str
    remaining_band_count: int = 0
    min_values: tuple[float, ...] | None = None
    max_values: tuple[float, ...] | None = None
    no_data_value: float | None = None

    @property
    def pixel_count(self) -> int:
        return self.width * self.height

    @property
    def sample_count(self) -> int:
        return self.pixel_count * self.depth

    @property
    def has_mask(self) -> bool:
        return self.mask_encoding != "None"

    @property
    def uses_external_mask(self) -> bool:
        return self.mask_encoding == "External"

    @property
    def raster_shape(self) -> tuple[int, ...]:
        return (self.height, self.width) if self.depth == 1 else (self.height, self.width, self.depth)

    @property
    def mask_shape(self) -> tuple[int, int]:
        return self.height, self.width

    def with_range(self, low: float, high: float) -> "BlobInfo":
        return replace(self, z_min=low, z_max=high)


class Cursor:
    """Bounded reads of a buffer."""

    def __init__(self, data, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = memoryview(data), at, len(data) if end is None else end

    def take(self, n: int) -> memoryview:
        if n > self.end - self.at:
            fail("Truncated", f"at byte {self.at}: {n} bytes are needed, {self.end - self.at} are there")
        self.at += n
        return self.data[self.at - n : self.at]

    def array(self, kind: str, n: int) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self.take(n * kind.itemsize), kind, n)

    def one(self, kind: str):
        return self.array(kind, 1)[0].item()

    @property
    def left(self) -> int:
        return self.end - self.at


def check_allocation(samples: int, item: int = 8) -> None:
    if samples * item > MAX_BYTES:
        fail("InvalidBlob", f"{samples} values are over the limit of {MAX_BYTES} bytes")
