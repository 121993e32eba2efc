"""Plane and local geodesic distances between positions and cable segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_E2 = 0.0066943799901413165


def clamp01(t: Column) -> Column:
    return F.when(t < 0, F.lit(0.0)).when(t > 1, F.lit(1.0)).otherwise(t)


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Fraction of the segment at which it comes closest to the point."""
    dx, dy = x2 - x1, y2 - y1
    return clamp01(F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0)))


def point_segment_sq(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance in degrees between a point and a segment."""
    t = along(px, py, x1, y1, x2, y2)
    ex, ey = px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1))
    return ex * ex + ey * ey


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross properly; touching ones are at distance 0 anyway."""
    s1, s2 = _side(*a, b[0], b[1]), _side(*a, b[2], b[3])
    s3, s4 = _side(*b, a[0], a[1]), _side(*b, a[2], a[3])
    return (s1 * s2 < 0) & (s3 * s4 < 0)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...], margin: float) -> Column:
    """Whether the bounding boxes of two segments come within a margin of each other."""
    return (
        (F.least(a[0], a[2]) <= F.greatest(b[0], b[2]) + margin)
        & (F.greatest(a[0], a[2]) >= F.least(b[0], b[2]) - margin)
        & (F.least(a[1], a[3]) <= F.greatest(b[1], b[3]) + margin)
        & (F.greatest(a[1], a[3]) >= F.least(b[1], b[3]) - margin)
    )


def segments_within(a: tuple[Column, ...], b: tuple[Column, ...], radius: float) -> Column:
    """Whether two segments come as close as ``radius`` degrees."""
    r2 = F.lit(radius * radius)
    return (
        segments_cross(a, b)
        | (point_segment_sq(a[0], a[1], *b) <= r2)
        | (point_segment_sq(a[2], a[3], *b) <= r2)
        | (point_segment_sq(b[0], b[1], *a) <= r2)
        | (point_segment_sq(b[2], b[3], *a) <= r2)
    )


def local_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between close positions from the radii of curvature at their mean latitude."""
    mid = F.radians((lat1 + lat2) / 2.0)
    w = 1.0 - WGS84_E2 * F.sin(mid) * F.sin(mid)
    north = F.radians(lat2 - lat1) * (WGS84_A * (1.0 - WGS84_E2)) / (w * F.sqrt(w))
    east = F.radians(lon2 - lon1) * WGS84_A / F.sqrt(w) * F.cos(mid)
    return F.sqrt(north * north + east * east)
