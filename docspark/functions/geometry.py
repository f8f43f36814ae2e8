"""Boxes: x0, y0, x1, y1 as four columns or a struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotate: Column) -> Column:
    """From points with the origin at the bottom left to shares of the page as it is shown, origin at the top left.
    Null for pages without size and for other rotations than quarter turns."""
    l, r, t, b = x0 / width, x1 / width, 1 - y1 / height, 1 - y0 / height
    turn = rotate % 360
    pick = lambda a, q, h, s: F.when(turn == 0, a).when(turn == 90, q).when(turn == 180, h).when(turn == 270, s)
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    box = F.struct(
        clamp(pick(l, 1 - b, 1 - r, t)).alias("x0"), clamp(pick(t, l, 1 - b, 1 - r)).alias("y0"),
        clamp(pick(r, 1 - t, 1 - l, b)).alias("x1"), clamp(pick(b, r, 1 - t, 1 - l)).alias("y1"))
    return F.when((width > 0) & (height > 0) & turn.isin(0, 90, 180, 270), box)


def to_pixels(box: Column, dpi: float, width: Column, height: Column) -> Column:
    """A canonical box in pixels of a page shown at dpi."""
    x, y = width * (dpi / 72.0), height * (dpi / 72.0)
    return F.struct((box.x0 * x).alias("x0"), (box.y0 * y).alias("y0"), (box.x1 * x).alias("x1"), (box.y1 * y).alias("y1"))


def contains_center(outer: str, inner: str) -> Column:
    c = lambda s, k: F.col(f"{s}_{k}")
    x, y = (c(inner, "x0") + c(inner, "x1")) / 2, (c(inner, "y0") + c(inner, "y1")) / 2
    return x.between(c(outer, "x0"), c(outer, "x1")) & y.between(c(outer, "y0"), c(outer, "y1"))


def iou(a: str, b: str) -> Column:
    c = lambda s, k: F.col(f"{s}_{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0"))
    both = w * h
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def overlaps(a: str, b: str, margin: float = 0.0) -> Column:
    c = lambda s, k: F.col(f"{s}_{k}")
    return ((c(a, "x0") - margin <= c(b, "x1")) & (c(b, "x0") <= c(a, "x1") + margin)
            & (c(a, "y0") - margin <= c(b, "y1")) & (c(b, "y0") <= c(a, "y1") + margin))


def quad_to_box(quad) -> Column:
    """The upright box around a quadrilateral, an array of points (x, y)."""
    q = F.col(quad) if isinstance(quad, str) else quad
    edge = lambda f, i: f(F.transform(q, lambda p: p[i]))
    return F.struct(edge(F.array_min, 0).alias("x0"), edge(F.array_min, 1).alias("y0"), edge(F.array_max, 0).alias("x1"), edge(F.array_max, 1).alias("y1"))
