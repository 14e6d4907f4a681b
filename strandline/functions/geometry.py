"""Planar and spatial measures as Column expressions; all of them stay inside generated code.

A segment is given by the names of its ends' columns with a common prefix:
``ends("g")`` stands for gx0, gy0, gz0, gx1, gy1, gz1, and ``ends("")`` for x0 .. z1.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Ends(NamedTuple):
    x0: Column
    y0: Column
    z0: Column
    x1: Column
    y1: Column
    z1: Column


def ends(prefix: str = "") -> Ends:
    return Ends(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "z0", "x1", "y1", "z1")))


def modulo(x: Column, m: float) -> Column:
    """Remainder with the sign of the divisor."""
    return x - F.lit(m) * F.floor(x / F.lit(m))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length_xy(s: Ends) -> Column:
    return norm(s.x1 - s.x0, s.y1 - s.y0)


def length(s: Ends) -> Column:
    """Length in space; in the plane if a height is NaN."""
    dz = s.z1 - s.z0
    return norm(s.x1 - s.x0, s.y1 - s.y0, F.when(F.isnan(dz), F.lit(0.0)).otherwise(dz))


def mean_height(s: Ends) -> Column:
    return (s.z0 + s.z1) * 0.5


def unit_xy(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Unit vector; the zero vector stays as it is."""
    n = norm(dx, dy)
    return F.when(n > 0, dx / n).otherwise(dx), F.when(n > 0, dy / n).otherwise(dy)


def along_xy(px: Column, py: Column, s: Ends, short: float = 0.0) -> Column:
    """Place of a point's projection on the line, 0 at the start and 1 at the end, not clamped; 0 where the squared length is ``short`` or less."""
    dx, dy = s.x1 - s.x0, s.y1 - s.y0
    square = dx * dx + dy * dy
    return F.when(square > short, ((px - s.x0) * dx + (py - s.y0) * dy) / square).otherwise(F.lit(0.0))


def along(px: Column, py: Column, pz: Column, s: Ends, short: float = 0.0) -> Column:
    dx, dy, dz = s.x1 - s.x0, s.y1 - s.y0, s.z1 - s.z0
    square = dx * dx + dy * dy + dz * dz
    return F.when(square > short, ((px - s.x0) * dx + (py - s.y0) * dy + (pz - s.z0) * dz) / square).otherwise(F.lit(0.0))


def distance_xy(px: Column, py: Column, s: Ends) -> Column:
    """To the segment, in the plane."""
    t = clamp(along_xy(px, py, s, 1e-30), 0.0, 1.0)
    return norm(px - s.x0 - t * (s.x1 - s.x0), py - s.y0 - t * (s.y1 - s.y0))


def distance(px: Column, py: Column, pz: Column, s: Ends) -> Column:
    """To the segment, in space."""
    t = clamp(along(px, py, pz, s, 1e-30), 0.0, 1.0)
    return norm(px - s.x0 - t * (s.x1 - s.x0), py - s.y0 - t * (s.y1 - s.y0), pz - s.z0 - t * (s.z1 - s.z0))


def line_distance_xy(px: Column, py: Column, s: Ends) -> Column:
    """To the infinite line through the segment, in the plane; to the point where the segment has no length."""
    dx, dy = s.x1 - s.x0, s.y1 - s.y0
    size = norm(dx, dy)
    return F.when(size > 0, F.abs(dx * (py - s.y0) - dy * (px - s.x0)) / size).otherwise(norm(px - s.x0, py - s.y0))


def line_distance_z(px: Column, py: Column, pz: Column, s: Ends) -> Column:
    """Difference of height between a point and its foot on the infinite line; null without heights."""
    gap = F.abs(pz - s.z0 - along(px, py, pz, s) * (s.z1 - s.z0))
    return F.when(F.isnan(gap), F.lit(None).cast("double")).otherwise(gap)


def project_on_line(px: Column, py: Column, ox: Column, oy: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Foot of a point on the line through o along d; o itself if d is zero."""
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((px - ox) * dx + (py - oy) * dy) / square).otherwise(F.lit(0.0))
    return ox + t * dx, oy + t * dy


def place_on_segment(px: Column, py: Column, pz: Column, s: Ends) -> Column:
    """Clamped place of the projection in space; in the plane if heights are missing."""
    t = along(px, py, pz, s)
    return clamp(F.when(F.isnan(t), along_xy(px, py, s)).otherwise(t), 0.0, 1.0)


def overlap_length_xy(base: Ends, other: Ends) -> Column:
    """Length of the base that lies between the feet of the other's ends."""
    a, b = along_xy(other.x0, other.y0, base), along_xy(other.x1, other.y1, base)
    low, high = F.greatest(F.lit(0.0), F.least(a, b)), F.least(F.lit(1.0), F.greatest(a, b))
    return F.greatest(F.lit(0.0), high - low) * length_xy(base)


def best_pairing_xy(a: Ends, b: Ends) -> Column:
    """Smaller of the two ways to pair the ends, each by its larger planar distance."""
    d = lambda p, q, r, s: norm(p - r, q - s)
    straight = F.greatest(d(a.x0, a.y0, b.x0, b.y0), d(a.x1, a.y1, b.x1, b.y1))
    turned = F.greatest(d(a.x0, a.y0, b.x1, b.y1), d(a.x1, a.y1, b.x0, b.y0))
    return F.least(straight, turned)


def within_tolerance(det: Ends, gt: Ends, tolerance: float) -> Column:
    """Half of the shorter one overlaps, and both ends of ``gt`` are near ``det``'s line; planar, false without length."""
    ld, lg = length_xy(det), length_xy(gt)
    ratio = F.when(ld <= lg, overlap_length_xy(det, gt) / ld).otherwise(overlap_length_xy(gt, det) / lg)
    near = (line_distance_xy(gt.x0, gt.y0, det) <= tolerance) & (line_distance_xy(gt.x1, gt.y1, det) <= tolerance)
    return (ld > 0) & (lg > 0) & F.coalesce(ratio >= 0.5, F.lit(False)) & near


def segment_key(s: Ends) -> Column:
    """Coordinates as identity: equal segments are one."""
    return F.struct(*s)


def box(mins: list[Column], maxs: list[Column]) -> Column:
    """Flat box: all minima, then all maxima."""
    return F.array(*mins, *maxs)


def normal_angle(s: Ends) -> Column:
    """Angle of the normal of an undirected planar line, in [0, pi)."""
    direction = modulo(F.atan2(s.y1 - s.y0, s.x1 - s.x0), math.pi)
    return modulo(direction + math.pi / 2, math.pi)
