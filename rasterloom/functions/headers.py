"""Blobs' headers as Catalyst expressions: metadata, ranges and what is wrong with a header, without a Python worker.

A header's bytes become hexadecimal digits once; numbers are cut out of those at places that the version
gives, so a filter on metadata runs inside the scan's stage, below any decoding. Doubles and floats are put
together from their sign, exponent and fraction, exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.codec.model import TYPES, dtype
from rasterloom.functions.blobs import INFO_NAMES, is_first_family, is_second_family
from rasterloom.operators import tiles

#: Bytes that any header ends within, its mask's size included.
HEAD = 94


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def unsigned(digits: Column, at: Column | int, n: int) -> Column:
    """n bytes, the lowest first, from byte at of hexadecimal digits; null where they aren't all there. n: at most 4."""
    at = F.lit(at) if isinstance(at, int) else at
    octets = [F.substr(digits, 2 * at + 2 * k + 1, F.lit(2)) for k in reversed(range(n))]
    return F.when(F.length(digits) >= 2 * (at + n), F.conv(F.concat(*octets), 16, 10).cast("long"))


def signed(digits: Column, at: Column | int, n: int) -> Column:
    half = 1 << (8 * n - 1)
    return _bound(unsigned(digits, at, n), lambda v: F.when(v >= half, v - 2 * half).otherwise(v))


def _real(sign: Column, exponent: Column, fraction: Column, fraction_bits: int, exponent_bits: int) -> Column:
    """The number of an IEEE layout. Whole numbers below 2**53 times powers of two: no rounding."""
    most, bias = (1 << exponent_bits) - 1, (1 << (exponent_bits - 1)) - 1 + fraction_bits
    two, whole = F.lit(2.0), F.lit(float(1 << fraction_bits))
    size = (
        F.when(exponent == most, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, fraction.cast("double") * F.pow(two, F.lit(1 - bias)))
        .otherwise((whole + fraction.cast("double")) * F.pow(two, exponent - bias))
    )
    return F.when(sign == 1, -size).otherwise(size)


def double_at(digits: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at

    def of(parts: Column) -> Column:
        low, high = parts["low"], parts["high"]
        fraction = high.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(1 << 32) + low
        return _real(F.shiftright(high, 31), F.shiftright(high, 20).bitwiseAND(F.lit(2047)), fraction, 52, 11)

    return _bound(F.struct(unsigned(digits, at, 4).alias("low"), unsigned(digits, at + 4, 4).alias("high")), of)


def float_at(digits: Column, at: Column | int) -> Column:
    return _bound(
        unsigned(digits, at, 4), lambda v: _real(F.shiftright(v, 31), F.shiftright(v, 23).bitwiseAND(F.lit(255)), v.bitwiseAND(F.lit((1 << 23) - 1)), 23, 8)
    )


def number_at(digits: Column, at: Column, kind: Column) -> Column:
    """A sample of the type that kind names, as a double."""
    found = F.lit(None).cast("double")
    for name in TYPES:
        n = dtype(name).itemsize
        read = {"f32": float_at, "f64": double_at}.get(name) or (lambda d, a, name=name, n=n: (signed if name[0] == "i" else unsigned)(d, a, n).cast("double"))
        found = F.when(kind == name, read(digits, at)).otherwise(found)
    return found


def _second(digits: Column, content: Column, verify: bool) -> Column:
    """The struct of a header of the second family, from the digits of its first HEAD bytes."""
    version = signed(digits, 6, 4)

    def placed(v: Column) -> Column:
        is_ = lambda least, n: F.when(v >= least, n).otherwise(0)
        base = is_(3, 4) + is_(4, 4)  # checksum; depth
        return F.struct(v.alias("version"), is_(3, 4).alias("checked"), base.alias("base"), is_(6, 8).alias("more"), (58 + base + is_(6, 24)).alias("mask_at"))

    def fields(p: Column) -> Column:
        v, base, reals = p["version"], p["base"], 34 + p["base"] + p["more"]
        six = v >= 6
        kind = signed(digits, 30 + base, 4)
        return F.struct(
            v.alias("version"),
            unsigned(digits, 14 + p["checked"], 4).alias("width"),
            unsigned(digits, 10 + p["checked"], 4).alias("height"),
            F.when(v >= 4, unsigned(digits, 22, 4)).otherwise(1).alias("depth"),
            unsigned(digits, 18 + base, 4).alias("valid"),
            signed(digits, 22 + base, 4).alias("micro"),
            signed(digits, 26 + base, 4).alias("size"),
            F.when(kind.between(0, len(TYPES) - 1), F.element_at(F.array(*map(F.lit, TYPES)), kind.cast("int") + 1)).alias("kind"),
            F.when(six, signed(digits, 34 + base, 4)).otherwise(0).alias("remaining"),
            F.when(six, unsigned(digits, 38 + base, 1)).otherwise(0).alias("flag"),
            F.when(six, unsigned(digits, 39 + base, 1)).otherwise(0).alias("whole"),
            double_at(digits, reals).alias("max_z"),
            double_at(digits, reals + 8).alias("low"),
            double_at(digits, reals + 16).alias("high"),
            F.when(six, double_at(digits, reals + 24)).otherwise(0.0).alias("encoded"),
            F.when(six, double_at(digits, reals + 32)).otherwise(0.0).alias("original"),
            unsigned(digits, p["mask_at"], 4).alias("n_mask"),
            (p["mask_at"] + 4).alias("end"),
        )

    return _bound(_bound(version, placed), lambda p: _bound(fields(p), lambda f: _shown(f, digits, content, verify)))


def _wrong(f: Column, digits: Column, content: Column, verify: bool) -> Column:
    """The kind of the first error of a header, in the order in which a reader finds them; null for none."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    pixels = f["width"] * f["height"]
    found = (
        F.when(~f["version"].between(1, 6), "UnsupportedVersion")
        .when(F.when(f["version"] >= 6, f["original"]).otherwise(f["high"]).isNull(), "Truncated")
        .when((f["width"] == 0) | (f["height"] == 0) | ~f["micro"].between(1, 32) | (f["depth"] == 0), "InvalidHeader")
        .when(~finite(f["max_z"]) | (f["max_z"] < 0) | ~finite(f["low"]) | ~finite(f["high"]) | (f["low"] > f["high"]), "InvalidHeader")
        .when(~finite(f["encoded"]) | ~finite(f["original"]) | (f["flag"] > 1) | (f["whole"] > 1) | (f["flag"] == 1) & (f["depth"] <= 1) | (f["remaining"] < 0), "InvalidHeader")
        .when(f["size"] <= 0, "InvalidHeader")
        .when(f["size"] > F.length(content), "Truncated")
    )
    if verify:
        sums = tiles.checksum(F.substring(content, F.lit(15), f["size"].cast("int") - 14))
        found = found.when((f["version"] >= 3) & (f["size"] < 14), "InvalidHeader").when((f["version"] >= 3) & (sums != unsigned(digits, 10, 4)), "ChecksumMismatch")
    bare = (f["valid"] == 0) | (f["valid"] == pixels)
    return found.when(f["valid"] > pixels, "InvalidBlob").when(f["n_mask"].isNull(), "Truncated").when(bare & (f["n_mask"] > 0), "InvalidBlob").when(f["kind"].isNull(), "InvalidBlob")


def _shown(f: Column, digits: Column, content: Column, verify: bool) -> Column:
    wrong = _wrong(f, digits, content, verify)
    hidden = f["flag"] == 1
    mask = F.when(f["valid"] == f["width"] * f["height"], "None").when(f["valid"] == 0, "ImplicitAllInvalid").when(f["n_mask"] > 0, "Explicit").otherwise("External")
    width = F.coalesce(*[F.when(f["kind"].isin(*[t for t in TYPES if dtype(t).itemsize == n]), n) for n in (1, 2, 4, 8)])
    ranged = (f["version"] >= 4) & (f["valid"] > 0) & (f["low"] != f["high"]) & ~hidden
    depth = f["depth"].cast("int")

    def ranges(first: Column) -> Column:
        raw = F.hex(F.substring(content, (f["end"] + f["n_mask"] + first * width + 1).cast("int"), (depth * width).cast("int")))
        return _bound(raw, lambda d: F.transform(F.sequence(F.lit(0), depth - 1), lambda k: number_at(d, k * width, f["kind"])))

    values = {
        "family": F.lit(2), "version": f["version"].cast("int"), "data_type": f["kind"], "width": f["width"], "height": f["height"], "depth": f["depth"].cast("long"),
        "min_values": F.when(ranged, ranges(F.lit(0))), "max_values": F.when(ranged, ranges(depth)), "valid_pixel_count": f["valid"], "micro_block_size": f["micro"].cast("int"),
        "blob_size": f["size"], "remaining_band_count": f["remaining"].cast("int"), "max_z_error": f["max_z"], "z_min": F.when(hidden, -1.0).otherwise(f["low"]),
        "z_max": F.when(hidden, -1.0).otherwise(f["high"]), "mask_encoding": mask, "no_data_value": F.when(hidden, f["original"]),
    }
    return _bound(wrong, lambda w: F.struct(*[F.when(w.isNull(), values[n]).alias(n) for n in INFO_NAMES], w.alias("error_kind")))


def header(content: Column, verify: bool = False) -> Column:
    """A struct of the 17 fields of the metadata of the first blob of content, and error_kind where its header is wrong.

    verify: the checksum over the whole blob is compared too. Masks and ranges aren't checked. Null content is all null;
    content of the first family tells UnsupportedFeature, as its fields need a scan of its blocks (use blobs.inspect).
    """
    second, first = is_second_family(content), is_first_family(content)
    other = F.when(content.isNotNull(), F.when(first, "UnsupportedFeature").otherwise("InvalidMagic"))
    found = F.when(second, _bound(F.hex(F.substring(content, 1, HEAD)), lambda d: _second(d, content, verify)))
    return _bound(found, lambda f: F.struct(*[f[n].alias(n) for n in INFO_NAMES], F.coalesce(f["error_kind"], F.when(f.isNull(), other)).alias("error_kind")))
