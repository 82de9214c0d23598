"""Angles and distances. Angles are in degrees; yaw grows counter-clockwise, pitch downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compat import clip


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs), F.lit(0.0)))


def view_vector(pitch: Column, yaw: Column) -> tuple[Column, Column, Column]:
    p, y = F.radians(pitch), F.radians(yaw)
    return F.cos(p) * F.cos(y), F.cos(p) * F.sin(y), -F.sin(p)


def angle_between(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    size = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((y * y for y in b), F.lit(0.0)))
    return F.degrees(F.acos(clip(F.try_divide(dot, size), -1.0, 1.0)))


def yaw_difference(a: Column, b: Column) -> Column:
    """The short way round, 0 to 180."""
    return F.abs(F.pmod(a - b + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def yaw_to(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def pitch_to(horizontal: Column, dz: Column) -> Column:
    return -F.degrees(F.atan2(dz, horizontal))


def circular_mean(yaw: Column) -> Column:
    """Aggregate: mean direction, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(yaw))), F.avg(F.cos(F.radians(yaw))))), F.lit(360.0))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")
