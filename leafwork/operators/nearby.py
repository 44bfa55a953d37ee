"""Boxes of one page that meet, without all pairs of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
LOW, TOP = 3, 15  # sides of cells are powers of two, from 8 points; the top cell is the whole page
FEW = 64


def _cells(b: Column, dense: Column) -> Column:
    """(level, cx, cy, own) of the cells that a box covers, on the first level whose cells are as large as the box and on all above."""
    x0, x1, y0, y1 = F.least(b["x0"], b["x1"]), F.greatest(b["x0"], b["x1"]), F.least(b["y0"], b["y1"]), F.greatest(b["y0"], b["y1"])
    size = F.greatest(x1 - x0, y1 - y0, F.lit(1.0))
    level = F.when(dense, F.least(F.lit(TOP), F.greatest(F.lit(LOW), F.ceil(F.log2(size)).cast("int")))).otherwise(TOP)

    def along(low, high, at):
        cell = lambda v: F.when(at == TOP, 0).otherwise(F.floor(v / F.pow(F.lit(2.0), at))).cast("long")
        return F.sequence(cell(low), cell(high))

    def on(at):
        place = lambda cx, cy: F.struct(at.alias("level"), cx.alias("cx"), cy.alias("cy"), (at == level).alias("own"))
        return F.flatten(F.transform(along(x0, x1, at), lambda cx: F.transform(along(y0, y1, at), lambda cy: place(cx, cy))))

    return F.flatten(F.transform(F.sequence(level, F.lit(TOP)), on))


def meeting(left: DataFrame, right: DataFrame, box: str, region: str) -> DataFrame:
    """Rows of both sides on one page whose ``box`` and ``region`` touch, and some more; a pair may come more than once.

    Two boxes that touch share a cell on the level of the larger one, where each covers about four cells.  So a pair meets only
    there, and a page is split over tasks by its cells.  A page with few regions is one cell: its pairs are linear in its boxes.
    Rows without a box meet nothing.
    """
    right = right.where(F.col(region).isNotNull())
    pages = right.groupBy(*PAGE).agg((F.count(F.lit(1)) > FEW).alias("_dense"))

    def dealt(rows, b, mine, other):
        # A cell of a box's own level meets both kinds of cells of the other side, one of a level above only those that are own.
        how = lambda c: F.when(~c["own"], F.array(F.lit(other))).when(F.col("_dense"), F.array(F.lit(0), F.lit(mine))).otherwise(F.array(F.lit(0)))
        out = rows.where(F.col(b).isNotNull()).join(pages, PAGE).withColumn("_c", F.explode(_cells(F.col(b), F.col("_dense"))))
        return out.withColumn("_how", F.explode(how(F.col("_c")))).select(*rows.columns, "_c.level", "_c.cx", "_c.cy", "_how")

    return dealt(left, box, 1, 2).join(dealt(right, region, 2, 1), [*PAGE, "level", "cx", "cy", "_how"]).drop("level", "cx", "cy", "_how")


def bands(low: Column, high: Column, height: float = 16.0) -> Column:
    """The numbers of all bands from low to high."""
    return F.sequence(band(low, height), band(high, height))


def band(y: Column, height: float = 16.0) -> Column:
    return F.floor(y / height).cast("long")
