"""Vectors and boxes as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; null for the zero vector."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v)))


def is_unit(v: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def box(x0, top, x1, bottom) -> Column:
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (x0, top, x1, bottom)])


def box_area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def x_overlap(a: Column, b: Column) -> Column:
    """Shared width as a share of the narrower box."""
    shared = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    narrow = F.least(a[2] - a[0], b[2] - b[0])
    return F.when(narrow > 0, shared / narrow).otherwise(0.0)


def y_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.greatest(a[1], b[1]) - F.least(a[3], b[3]), F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def expand(b: Column, by: float) -> Column:
    return F.array(b[0] - by, b[1] - by, b[2] + by, b[3] + by)


def shift(b: Column, dx: Column, dy: Column) -> Column:
    return F.array(b[0] - dx, b[1] - dy, b[2] - dx, b[3] - dy)


def intersects(a: Column, b: Column) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def to_pdf_points(b: Column, page_height: Column, x0: Column, y0: Column) -> Column:
    """A box from the top as native coordinates from the bottom, with the page's origin added."""
    return F.array(b[0] + x0, page_height - b[3] + y0, b[2] + x0, page_height - b[1] + y0)


def apart(boxes: Column, tolerance: float = 2.0) -> Column:
    """The boxes of an array, in order, without those whose every side is within tolerance of a kept one's. boxes: array of structs with a field box."""

    def step(kept, x):
        near = F.exists(kept, lambda y: F.forall(F.zip_with(x["box"], y["box"], lambda a, b: F.abs(a - b) <= tolerance), lambda ok: ok))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)
