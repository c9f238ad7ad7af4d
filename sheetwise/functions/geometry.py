"""Column expressions over boxes: four columns x0, y0, x1, y1 with the origin at the top left, in points."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{k}{suffix}") for k in ("x0", "y0", "x1", "y1")])


def area(a: Box) -> Column:
    return (a.x1 - a.x0) * (a.y1 - a.y0)


def intersection(a: Box, b: Box) -> Column:
    """Area of the overlap, 0 if there is none."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def iou(a: Box, b: Box, clamp: bool = False) -> Column:
    """Overlap over union; 0 without overlap or with a union that isn't positive. clamp: negative areas count as 0."""
    both = intersection(a, b)
    sizes = [F.greatest(F.lit(0.0), area(x)) if clamp else area(x) for x in (a, b)]
    union = sizes[0] + sizes[1] - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def overlaps(a: Box, b: Box, touching: bool = False) -> Column:
    if touching:
        return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def coverage(a: Box, b: Box) -> Column:
    """The part of a that b covers."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def pad(a: Box, margin: float, width: float, height: float) -> Box:
    return Box(F.greatest(F.lit(0.0), a.x0 - margin), F.greatest(F.lit(0.0), a.y0 - margin), F.least(F.lit(width), a.x1 + margin), F.least(F.lit(height), a.y1 + margin))


def y_overlap(a: Box, b: Box) -> Column:
    """Vertical overlap as a part of the lower box's height; 0 for a box without height."""
    shorter = F.least(a.y1 - a.y0, b.y1 - b.y0)
    return F.when(shorter > 0, F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)) / shorter).otherwise(0.0)


def center(a: Box) -> tuple[Column, Column]:
    return (a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2


def contains_center(outer: Box, inner: Box, margin: float = 0.0) -> Column:
    x, y = center(inner)
    return (x >= outer.x0 - margin) & (x <= outer.x1 + margin) & (y >= outer.y0 - margin) & (y <= outer.y1 + margin)


def rotate(a: Box, degrees: float, width: float, height: float) -> Box:
    """The box around the four corners turned about the page's centre."""
    s, c = F.sin(F.radians(F.lit(degrees))), F.cos(F.radians(F.lit(degrees)))
    mx, my = F.lit(width / 2), F.lit(height / 2)
    corners = [((x - mx) * c - (y - my) * s + mx, (x - mx) * s + (y - my) * c + my) for x in (a.x0, a.x1) for y in (a.y0, a.y1)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd ray cast; points: array of struct<x, y>."""
    n = F.size(points)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, (i + 1) % n).alias("b")))
    crossed = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.when(n >= 3, F.size(crossed) % 2 == 1).otherwise(False)


def line_angle(a: Box) -> Column:
    return F.degrees(F.atan2(F.abs(a.y1 - a.y0), F.abs(a.x1 - a.x0)))


def zone_of(fx: Column, fy: Column, margin: float = 0.15) -> Column:
    """Corner, margin, center or field of a point in page fractions."""
    ex, ey = (fx < margin) | (fx > 1 - margin), (fy < margin) | (fy > 1 - margin)
    middle = fx.between(0.35, 0.65) & fy.between(0.35, 0.65)
    return F.when(ex & ey, "corner").when(ex | ey, "margin").when(middle, "center").otherwise("field")
