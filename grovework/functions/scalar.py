"""Scalar functions: feature tests and values, distances, region codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale of integer thresholds of box features.
INTEGRAL_SCALE = 2147483646
BANDS = 7


def vector_test(value: Column, kind: Column, t: Column) -> Column:
    """Whether a value passes: equality for kind 2 (categorical), else value >= t."""
    return F.when(kind == 2, value == t).otherwise(value >= t)


def clamp(x: Column, size: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), size - 1)


def texton_value(kind: Column, v0: Column, v1: Column) -> Column:
    """kind 0: v0; 1: sum; 2: difference; 3: absolute difference."""
    return (
        F.when(kind == 0, v0).when(kind == 1, v0 + v1).when(kind == 2, v0 - v1).when(kind == 3, F.abs(v0 - v1))
    )


def pixel(pixels: Column, height: Column, width: Column, i: Column, j: Column, band: Column) -> Column:
    """Value of an interleaved pixel array at clamped (i, j); 0 for a band that isn't there."""
    at = (clamp(i, height) * width + clamp(j, width)) * BANDS + band
    return F.when((band >= 0) & (band < BANDS), F.get(pixels, at.cast("int"))).otherwise(0)


def box_edges(i: Column, j: Column, p: dict[str, Column], height: Column, width: Column) -> dict[str, Column]:
    """Box edges in table coordinates, clamped; p: uy, ux (centre offset), bh, bw (radii)."""
    return {
        "y0": clamp(i + p["uy"] - p["bh"], height),
        "y1": clamp(i + p["uy"] + p["bh"] + 1, height),
        "x0": clamp(j + p["ux"] - p["bw"], width),
        "x1": clamp(j + p["ux"] + p["bw"] + 1, width),
    }


def inner_edges(lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Where the first and the second third of a side end, and its half: whole numbers, rounded down."""
    d = hi - lo
    return tuple((lo + F.floor(d * k / n)).cast("int") for k, n in ((1, 3), (2, 3), (1, 2)))


def integral_value(pattern: Column, e: dict[str, Column], at: Callable[[Column, Column], Column]) -> Column:
    """Box feature of a prefix-sum table, scaled to an integer; 0 for a box without area.

    Patterns: 0 box, 1 box less its centre third, 2 right less left half, 3 top
    less bottom half, 4 thirds left - middle + right, 5 thirds top - middle +
    bottom, 6 top right less the other quarters.
    """
    y0, y1, x0, x1 = e["y0"], e["y1"], e["x0"], e["x1"]
    dy, dx = y1 - y0, x1 - x0
    ya, yb, ym = inner_edges(y0, y1)
    xa, xb, xm = inner_edges(x0, x1)

    def box(a: Column, b: Column, c: Column, d: Column) -> Column:
        return at(c, d) - at(a, d) - at(c, b) + at(a, b)

    out = (
        F.when(pattern == 0, box(y0, x0, y1, x1))
        .when(pattern == 1, box(y0, x0, y1, x1) - box(ya, xa, yb, xb))
        .when(pattern == 2, box(y0, xm, y1, x1) - box(y0, x0, y1, xm))
        .when(pattern == 3, box(y0, x0, ym, x1) - box(ym, x0, y1, x1))
        .when(pattern == 4, box(y0, x0, y1, xa) - box(y0, xa, y1, xb) + box(y0, xb, y1, x1))
        .when(pattern == 5, box(y0, x0, ya, x1) - box(ya, x0, yb, x1) + box(yb, x0, y1, x1))
        .when(pattern == 6, box(y0, xm, ym, x1) - box(y0, x0, ym, xm) - box(ym, x0, y1, xm) - box(ym, xm, y1, x1))
    )
    area = dy * dx
    return F.when(area > 0, (out / area * INTEGRAL_SCALE).cast("long")).otherwise(F.lit(0).cast("long"))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sq_l2_dist(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def encode_region(region: Column) -> list[Column]:
    """Three bytes of a region id, lowest first."""
    return [F.pmod(F.floor(region / k), F.lit(256)).cast("int") for k in (1, 256, 65536)]


def decode_region(b0: Column, b1: Column, b2: Column) -> Column:
    return b0 + 256 * b1 + 65536 * b2


def region_color(region: Column) -> list[Column]:
    """A repeatable colour of a region: three bytes of a hash of its id."""
    h = (region.cast("long") * 1103515245 + 12345) % 2147483648
    return [F.pmod(F.floor(h / k), F.lit(256)).cast("int") for k in (256, 4096, 65536)]


def signed_confidence(label: Column, confidence: Column) -> Column:
    return label * confidence
