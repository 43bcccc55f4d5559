"""Geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, metres_per_degree: float = 111195.0) -> Column:
    """Metres from a point to a segment on the local plane."""
    k = F.cos(F.radians(py))
    ax, ay, bx, by = (px - x1) * k, py - y1, (x2 - x1) * k, y2 - y1
    t = along_segment(px, py, x1, y1, x2, y2)
    return F.sqrt(F.pow(ax - t * bx, 2) + F.pow(ay - t * by, 2)) * metres_per_degree


def along_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of a segment, 0 to 1, at which it is nearest to a point on the local plane."""
    k = F.cos(F.radians(py))
    ax, ay, bx, by = (px - x1) * k, py - y1, (x2 - x1) * k, y2 - y1
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(ax * bx + ay * by, bx * bx + by * by), F.lit(0.0))))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")
