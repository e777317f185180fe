"""Coordinate frames and scalar functions, as column expressions.

Names say the frame: *_deg WGS84 degrees, *_m metres, *_px pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, MERCATOR_M = 6371008.8, 6378137.0


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres from an origin (the mean of the node set in hand)."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_M, F.radians(lat - lat0) * EARTH_M


def tile_pixel_to_deg(row: Column, col: Column, width: Column, height: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> tuple[Column, Column]:
    """Pixel centres; rows run down."""
    w, h = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height)
    return minx + ((col + 0.5) / w) * (maxx - minx), maxy - ((row + 0.5) / h) * (maxy - miny)


def deg_to_eval_px(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column, size: int) -> tuple[Column, Column]:
    """(col, row) at pixel corners: clamped, then rounded half to even."""
    fit = lambda v: F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(size - 1.0))).cast("long")
    return fit((lon - west) / (east - west) * (size - 1)), fit((north - lat) / (north - south) * (size - 1))


def px_to_mercator(row: Column, col: Column, width: int, height: int, minx: Column, miny: Column, maxx: Column, maxy: Column) -> tuple[Column, Column]:
    return minx + col / F.lit(width - 1.0) * (maxx - minx), maxy - row / F.lit(height - 1.0) * (maxy - miny)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - F.lit(math.pi / 2))


def metric_to_px(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, width: int, height: int) -> tuple[Column, Column]:
    """(row, col): truncated, y turned, held inside the picture."""
    held = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v.cast("long")))
    return held((maxy - y) / (maxy - miny) * (height - 1), height), held((x - minx) / (maxx - minx) * (width - 1), width)


#: The synthetic frame of the graph JSON: anchored at these degrees, at zoom 20.
ANCHOR_LAT, ANCHOR_LON, ZOOM = 41.0, -71.0, 20


def synthetic_deg(row: Column, col: Column) -> tuple[Column, Column]:
    per_px = 156543.03392804062 * math.cos(math.radians(ANCHOR_LAT)) / 2**ZOOM
    return F.lit(ANCHOR_LAT) - row * per_px / 111111.0, F.lit(ANCHOR_LON) + col * per_px / (111111.0 * math.cos(math.radians(ANCHOR_LAT)))


def planar_gps_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres at 111111 a degree; longitude shrunk by the first point's latitude."""
    a, b = (lat1 - lat2) * 111111.0, (lon1 - lon2) * 111111.0 * F.cos(F.radians(lat1))
    return F.sqrt(a * a + b * b)


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def foreground(r: Column, g: Column, b: Column, threshold: float | None, invert: bool = False) -> Column:
    """Is the greatest channel over (or, inverted, under) the threshold; without one: is it non-zero."""
    top = F.greatest(r, g, b)
    if threshold is None:
        return top > 0
    return top < threshold if invert else top > threshold


def first_max(values: Column) -> Column:
    """Place of the greatest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def to_byte(p: Column) -> Column:
    return (p * 255).cast("int")


def rotate_patch(x: Column, y: Column, size: Column, k: Column, hflip: Column, vflip: Column) -> tuple[Column, Column]:
    """Patch points turned by k quarters about the patch's centre, then mirrored."""
    rx = F.when(k == 0, x).when(k == 1, y).when(k == 2, size - x).otherwise(size - y)
    ry = F.when(k == 0, y).when(k == 1, size - x).when(k == 2, size - y).otherwise(x)
    return F.when(hflip, size - rx - 1).otherwise(rx), F.when(vflip, size - ry - 1).otherwise(ry)


def normalise(value: Column, mean: float, std: float) -> Column:
    return (value / 255.0 - mean) / std


def sinusoid(x: Column, dims: int) -> Column:
    """array<double>: sine and cosine of x at ``dims`` // 2 frequencies."""
    freq = [10000 ** (-2 * i / dims) for i in range(dims // 2)]
    return F.concat(F.array(*[F.sin(x * f) for f in freq]), F.array(*[F.cos(x * f) for f in freq]))


# ---- patch grids ---------------------------------------------------------------------


def spaced(start: Column, end: Column, n: Column) -> Column:
    """array<bigint>: n evenly spaced places from start to end, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.rint(F.when(n == 1, start.cast("double")).otherwise(start + i * ((end - start) / F.nullif(n - 1, F.lit(0))))).cast("long"))


def edge_inclusive(length: Column, patch: Column, n: Column, margin: Column) -> Column:
    """Patch starts along an axis that include 0 and the far edge; sorted, without repeats."""
    end = (length - patch).cast("long")
    lo = F.least(F.greatest(F.lit(0), margin), end)
    hi = F.greatest(F.least(end - margin, end), lo)
    inner = F.when((n > 2) & (hi > lo), spaced(lo, hi, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    ends = F.when(n <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), end))
    return F.array_sort(F.array_distinct(F.transform(F.concat(ends, inner), lambda c: F.greatest(F.lit(0).cast("long"), F.least(end, c)))))


def strided(length: Column, patch: Column, margin: Column, least: Column) -> Column:
    """Patch starts that cover an axis; the last touches the edge; evenly spaced if under ``least``."""
    end = (length - patch).cast("long")
    step = F.greatest(F.lit(1).cast("long"), (patch - 2 * margin).cast("long"))
    base = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), end, step), F.array(end)))
    return F.when(F.size(base) < least, spaced(F.lit(0), end, least)).otherwise(base)


def coverage_patches(length: Column, patch: Column, overlap: Column) -> Column:
    o = F.least(F.lit(0.95), F.greatest(F.lit(0.0), overlap))
    return F.when(length <= patch, 1).otherwise(F.ceil((length - patch) / (patch * (1 - o))).cast("int") + 1)


def project_line(points: Column) -> Column:
    """array<struct<x, y>> of degrees in mercator metres."""

    def one(p: Column) -> Column:
        x, y = mercator(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)
