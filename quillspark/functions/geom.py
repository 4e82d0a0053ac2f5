"""Rectangle expressions over struct columns (x0, y0, x1, y1); contact of edges is no overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def area(r: Column) -> Column:
    return (r.x1 - r.x0) * (r.y1 - r.y0)


def shared_width(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))


def shared_height(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def shared_area(a: Column, b: Column) -> Column:
    return shared_width(a, b) * shared_height(a, b)


def x_overlap(a: Column, b: Column) -> Column:
    """Shared width over the smaller width (1 where that is less)."""
    return shared_width(a, b) / F.greatest(F.lit(1.0), F.least(a.x1 - a.x0, b.x1 - b.x0))


def iou(a: Column, b: Column) -> Column:
    both = shared_area(a, b)
    return F.when(area(a) + area(b) - both > 0, both / (area(a) + area(b) - both)).otherwise(F.lit(0.0))


def bbox(r: Column) -> Column:
    """Union of a group's rectangles."""
    return F.struct(F.min(r.x0).alias("x0"), F.min(r.y0).alias("y0"), F.max(r.x1).alias("x1"), F.max(r.y1).alias("y1"))


def center_in(a: Column, b: Column) -> Column:
    """The centre of a lies in b, upper and left edges included."""
    x, y = (a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2
    return (x >= b.x0) & (x < b.x1) & (y >= b.y0) & (y < b.y1)
