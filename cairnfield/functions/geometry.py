"""Distances, boxes and voxels as columns. All arithmetic on coordinates is done on floats;
every cast stands here, as Spark widens divisions and literals to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnfield.schema import AXES, Box

#: Points closer than this on every axis are the same point.
SAME = 1e-6
#: Widening of double-precision bounds that must not cut off what floats accept.
SLACK = 1e-5


def real(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def axes(prefix: str = "", suffix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in AXES)


def dist_sq(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Squared distance in float, summed as (x + y) + z."""
    dx, dy, dz = (p - q for p, q in zip(a, b, strict=True))
    return (dx * dx + dy * dy) + dz * dz


def box_dist_sq(p: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    """Squared distance, in double, from a point to the nearest place of a box."""
    total = F.lit(0.0)
    for v, lo, hi in zip(p, low, high, strict=True):
        gap = F.greatest(lo.cast("double") - v.cast("double"), v.cast("double") - hi.cast("double"), F.lit(0.0))
        total = total + gap * gap
    return total


def box_far_sq(p: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    """Squared distance, in double, from a point to the farthest corner of a box."""
    total = F.lit(0.0)
    for v, lo, hi in zip(p, low, high, strict=True):
        gap = F.greatest(F.abs(v.cast("double") - lo.cast("double")), F.abs(hi.cast("double") - v.cast("double")))
        total = total + gap * gap
    return total


def in_box(p: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...]) -> Column:
    out = F.lit(True)
    for v, lo, hi in zip(p, low, high, strict=True):
        out = out & (v >= lo) & (v < hi)
    return out


def in_fixed_box(box: Box) -> Column:
    return in_box(axes(), tuple(map(real, box.low)), tuple(map(real, box.high)))


def voxel_key(size: float) -> tuple[Column, Column, Column]:
    """Whole-numbered voxel of a point; a point on a voxel's float edge is never lost."""
    return tuple(F.floor((F.col(a) / real(size)).cast("float")).cast("long") for a in AXES)


def voxel_centre(size: float) -> tuple[Column, Column, Column]:
    """Centre of a point's voxel: edges in float, their middle in double, then narrowed."""
    out = []
    for a in AXES:
        low = (F.floor((F.col(a) / real(size)).cast("float")).cast("float") * real(size)).cast("float")
        high = (low + real(size)).cast("float")
        out.append((low.cast("double") + (high - low).cast("double") / F.lit(2.0)).cast("float"))
    return tuple(out)


def same_point(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & (F.abs(p - q).cast("double") < F.lit(SAME))
    return out
