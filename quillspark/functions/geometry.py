"""Boxes (left, top, right, bottom) as arrays of four doubles, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a gold box that must lie inside, and how many times larger a located block may be. Fixed values.
CONTAINED, GRANULARITY = 0.5, 12


def parts(box: Column) -> list[Column]:
    return [F.element_at(box, i) for i in (1, 2, 3, 4)]


def unit_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Absolute to relative coordinates, clamped to the page."""
    low = lambda x, n: F.greatest(F.lit(0.0), x / n)
    high = lambda x, n: F.least(F.lit(1.0), x / n)
    return F.array(low(left, width), low(top, height), high(right, width), high(bottom, height))


def flip(top: Column, bottom: Column, height: Column, origin: Column) -> tuple[Column, Column]:
    """Top and bottom measured from above, whatever the origin."""
    below = origin == "BOTTOMLEFT"
    return F.when(below, height - top).otherwise(top), F.when(below, height - bottom).otherwise(bottom)


def area(box: Column) -> Column:
    """Area of a box; 0 for one that is inverted."""
    a, b, c, d = parts(box)
    return F.greatest(F.lit(0.0), c - a) * F.greatest(F.lit(0.0), d - b)


def contained(gold: Column, other: Column) -> Column:
    """Share of the gold box inside the other; 0 without a box or an area."""
    (a, b, c, d), (e, f, g, h) = parts(gold), parts(other)
    wide, high = F.greatest(F.lit(0.0), F.least(c, g) - F.greatest(a, e)), F.greatest(F.lit(0.0), F.least(d, h) - F.greatest(b, f))
    share = F.when(gold.isNotNull() & other.isNotNull(), F.try_divide(wide * high, area(gold)))  # greatest and least pass over nulls
    return F.coalesce(share, F.lit(0.0))


def gold_box(observed: Column, box: Column, rotation: Column) -> Column:
    """The observed box, else the drawn one if the page isn't rotated."""
    return F.coalesce(observed, F.when(rotation == 0, box))


def located(gold: Column, block: Column, is_cell: Column, content_area: Column) -> Column:
    """Whether a block's box locates the gold box: it holds half of it and is a cell or not too large."""
    return F.coalesce((contained(gold, block) >= CONTAINED) & (is_cell | (area(block) <= GRANULARITY * content_area)), F.lit(False))


def rotated(box: Column, degrees: Column, width: Column, height: Column) -> Column:
    """Upright box around a relative box turned about the page's centre, clamped."""
    a, b, c, d = parts(box)
    rad = F.radians(degrees)
    cos, sin = F.cos(rad), F.sin(rad)
    xs, ys = [], []
    for x, y in ((a, b), (c, b), (c, d), (a, d)):
        dx, dy = (x - 0.5) * width, (y - 0.5) * height
        xs.append((dx * cos + dy * sin) / width + 0.5)
        ys.append((dy * cos - dx * sin) / height + 0.5)
    return F.array(F.greatest(F.lit(0.0), F.least(*xs)), F.greatest(F.lit(0.0), F.least(*ys)), F.least(F.lit(1.0), F.greatest(*xs)), F.least(F.lit(1.0), F.greatest(*ys)))


def valid(box: Column) -> Column:
    """Four coordinates within the page, left before right and top before bottom."""
    a, b, c, d = (F.get(box, i) for i in range(4))
    return F.coalesce((F.size(box) == 4) & (a >= 0) & (a < c) & (c <= 1) & (b >= 0) & (b < d) & (d <= 1), F.lit(False))
