"""Geometry of boxes and segments as Column expressions. Boxes are left, top, width, height or x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_box(vertices: Column) -> Column:
    """Struct x0, y0, x1, y1 around an array of (x, y)."""
    x, y = vertices["x"], vertices["y"]
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def union_box(a: Column, b: Column) -> Column:
    return F.struct(*(f(a[n], b[n]).alias(n) for n, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))))


def contains_box(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def direction(a: Column, b: Column) -> Column:
    """Where b lies of a: left, right, or overlap where their x ranges meet."""
    return F.when(b["x1"] < a["x0"], "left").when(a["x1"] < b["x0"], "right").otherwise("overlap")


def clamp(v: Column, most: Column | float) -> Column:
    return F.least(F.greatest(v, F.lit(0)), most if isinstance(most, Column) else F.lit(most))


def y_at(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    """y of a segment's line at x; a vertical one gives the middle of its ys."""
    return F.when(x1 == x2, (y1 + y2) / 2).otherwise(y1 + (y2 - y1) * (x - x1) / F.nullif(x2 - x1, F.lit(0)))


def hough_segment(rho: Column, theta: Column, width: Column, height: Column) -> Column:
    """Struct x1, y1, x2, y2: the line of a Hough cell, ten image widths to either side, cut to the image."""
    c, s, far = F.cos(theta), F.sin(theta), 10 * width
    ends = (("x1", rho * c - far * s, width), ("y1", rho * s + far * c, height), ("x2", rho * c + far * s, width), ("y2", rho * s - far * c, height))
    return F.struct(*(clamp(v.cast("int"), most).alias(n) for n, v, most in ends))


def near_horizontal(x1: Column, y1: Column, x2: Column, y2: Column, factor: int = 10) -> Column:
    return F.abs(x2 - x1) > factor * F.abs(y2 - y1)


def near_vertical(x1: Column, y1: Column, x2: Column, y2: Column, factor: int = 10) -> Column:
    return F.abs(y2 - y1) > factor * F.abs(x2 - x1)


def line_crosses(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """A segment from left to right passes through a box: the box's upper left corner is above it and the lower right one below."""
    right, bottom = left + width, top + height
    return (x1 <= right) & (x2 >= left) & (top <= y_at(x1, y1, x2, y2, left)) & (bottom >= y_at(x1, y1, x2, y2, right))


def right_crop(left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column, border: int = 10, reach: int = 150) -> Column:
    """The rectangle to the right of a word, cut to the image."""
    return F.struct(clamp(left + width, image_width).alias("x0"), clamp(top - border, image_height).alias("y0"), clamp(left + width + reach, image_width).alias("x1"), clamp(top + height + border, image_height).alias("y1"))
