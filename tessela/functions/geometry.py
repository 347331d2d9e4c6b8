"""Column functions on boxes, points and rings in unit coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box within the unit square, its corners in order."""
    unit = lambda c: F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0))
    a, b, c, d = unit(x0), unit(y0), unit(x1), unit(y1)
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def overlap(a: Column, b: Column) -> Column:
    """The overlap of two boxes; null where they don't meet."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def pixel_rect(b: Column, width: int, height: int) -> Column:
    """A box in pixels, halves rounded to even, within the image."""
    at = lambda c, n: F.least(F.greatest(F.bround(c * n).cast("int"), F.lit(0)), F.lit(n))
    return F.struct(at(b["x0"], width).alias("x0"), at(b["y0"], height).alias("y0"), at(b["x1"], width).alias("x1"), at(b["y1"], height).alias("y1"))


def to_pixel(x: Column, y: Column, width: int, height: int, inclusive: bool = True) -> Column:
    """A unit point as a pixel: scaled by size - 1 (``inclusive``) or by size, and kept within the image."""
    cut = 1 if inclusive else 0
    at = lambda c, n: F.least(F.greatest(F.bround(c * (n - cut)).cast("int"), F.lit(0)), F.lit(n - 1))
    return F.struct(at(x, width).alias("x"), at(y, height).alias("y"))


def covered(points: Column, boxes: Column) -> Column:
    """Whether every point of a line (structs x, y) lies in one of the boxes, borders included."""
    return F.forall(points, lambda p: F.exists(boxes, lambda b: (p["x"] >= b["x0"]) & (p["x"] <= b["x1"]) & (p["y"] >= b["y0"]) & (p["y"] <= b["y1"])))


def round_ring(ring: Column, digits: int = 7) -> Column:
    """The points of a ring rounded; null gives an empty ring."""
    return F.coalesce(F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))


def pulse(frame: Column, count: int) -> Column:
    """A smooth rise from 0 to 1 over the frames."""
    return 0.5 - 0.5 * F.cos(math.pi * frame / max(1, count - 1))


def wkt_line(points: Column) -> Column:
    """A line of points (structs x, y) as well-known text; EMPTY without points, null for null."""
    body = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.when(F.size(points) > 0, F.concat(F.lit("LINESTRING ("), body, F.lit(")"))).when(points.isNotNull(), "LINESTRING EMPTY")


def wkt_polygon(border: Column, holes: Column) -> Column:
    """A border and its holes as well-known text, rings closed; EMPTY without a border, null for null."""
    def ring(r: Column) -> Column:
        closed = F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
        return F.concat(F.lit("("), F.array_join(F.transform(closed, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))

    inner = F.transform(F.filter(F.coalesce(holes, F.slice(F.array(border), 1, 0)), lambda h: F.size(h) > 0), ring)
    return F.when(F.size(border) > 0, F.concat(F.lit("POLYGON ("), F.array_join(F.concat(F.array(ring(border)), inner), ", "), F.lit(")"))).when(border.isNotNull(), "POLYGON EMPTY")
