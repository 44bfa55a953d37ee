"""Boxes as structs (x0, y0, x1, y1) in points, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def box(x0, y0, x1, y1) -> Column:
    named = zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in named])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the area of a, which counts as 1 at least; 0 if a box is missing."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when(a.isNotNull() & b.isNotNull() & (w > 0) & (h > 0), w * h / F.greatest(area(a), F.lit(1.0))).otherwise(0.0)


def centre_inside(a: Column, b: Column, padding: float = 0.0) -> Column:
    cx, cy = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return cx.between(b["x0"] - padding, b["x1"] + padding) & cy.between(b["y0"] - padding, b["y1"] + padding)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def union_all(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def padded(b: Column, width: Column, height: Column, by: float = 8.0) -> Column:
    return box(F.greatest(F.lit(0.0), b["x0"] - by), F.greatest(F.lit(0.0), b["y0"] - by), F.least(width, b["x1"] + by), F.least(height, b["y1"] + by))


def crop_sides(c: Column, width: Column) -> tuple[Column, Column]:
    """Left and right of a crop for the caption box c."""
    return F.greatest(F.lit(8.0), F.least(c["x0"] - 34, width * 0.015)), F.least(width - 8, F.greatest(c["x1"] + 34, width * 0.985))


def figure_crop(c: Column, width: Column, height: Column, above: Column) -> Column:
    """Crop above a caption.  ``above``: the lowest bottom of the blocks that end above c.y0 - 8 and below 12 % of the page, or null."""
    x0, x1 = crop_sides(c, width)
    start = F.when(c["y0"] > height * 0.65, 40.0).otherwise(F.coalesce(above, F.lit(40.0)))
    y0 = F.greatest(F.lit(40.0), start - 18)
    y1 = F.greatest(y0 + 80, c["y0"] - 4)
    low = y1 - y0 < 100
    y0 = F.when(low, F.greatest(F.lit(40.0), c["y0"] - height * 0.52)).otherwise(y0)
    return box(x0, y0, x1, F.least(F.greatest(y0 + 80, c["y0"] - 4), height - 8))


def table_crop(c: Column, width: Column, height: Column, next_caption: Column, dense: Column) -> Column:
    """Crop below a caption.  ``next_caption``: top of the next caption over 30 points below; ``dense``: lowest bottom of the blocks near below."""
    x0, x1 = crop_sides(c, width)
    y1 = F.coalesce(next_caption - 8, dense + 8, height - 44)
    y0 = F.least(height - 120, c["y1"] + 3)
    return box(x0, F.greatest(F.lit(40.0), y0), x1, F.least(F.greatest(y0 + 80, y1), height - 8))


def next_page_crop(width: Column, height: Column, first_caption: Column) -> Column:
    """Crop at the head of the next page, down to its first caption if that lies below 35 % of it."""
    bottom = F.when(first_caption > height * 0.35, first_caption - 4).otherwise(height - 44)
    return box(8.0, 40.0, width - 8, F.greatest(F.lit(140.0), bottom))
