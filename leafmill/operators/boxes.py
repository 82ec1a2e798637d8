"""Box geometry and region relations of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.spatial import meeting


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    c = lambda s, n: F.col(f"{s}.{n}")
    inner = area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))
    one, two = (area(c(s, "x0"), c(s, "y0"), c(s, "x1"), c(s, "y1")) for s in (a, b))
    return F.when(one + two - inner > 0, inner / (one + two - inner)).otherwise(0.0)


def overlapping_pairs(regions: DataFrame, *, least: float = 0.1, cell: float = 256.0) -> DataFrame:
    """Pairs of regions of one page with an IoU of ``least`` or more, the lesser ``rid`` first.

    Regions meet in the grid cells that they touch, each pair in its first common cell only; rows that share a
    ``rid`` are one region and make no pair.
    """
    rows = regions.select("page", "rid", "x0", "y0", "x1", "y1")
    pairs = meeting(rows, rows, ["page"], cell=cell).where(F.col("a.rid") < F.col("b.rid"))
    return pairs.select("page", F.col("a.rid").alias("rid_a"), F.col("b.rid").alias("rid_b"), F.round(iou("a", "b"), 6).alias("iou")).where(F.col("iou") >= least)


def hull(regions: DataFrame, by: list[str]) -> DataFrame:
    return regions.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("regions"))


def affine(df: DataFrame, m: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Boxes under x' = a x + b y + c, y' = d x + e y + f: the hull of the mapped corners."""
    a, b, c, d, e, f = m
    xs = [a * F.col(x) + b * F.col(y) + c for x in ("x0", "x1") for y in ("y0", "y1")]
    ys = [d * F.col(x) + e * F.col(y) + f for x in ("x0", "x1") for y in ("y0", "y1")]
    keep = [k for k in df.columns if k not in ("x0", "y0", "x1", "y1")]
    return df.select(*keep, *(F.round(g(*v), 6).alias(n) for g, v, n in ((F.least, xs, "x0"), (F.least, ys, "y0"), (F.greatest, xs, "x1"), (F.greatest, ys, "y1"))))


def px_to_mm(px: Column, dpi: Column) -> Column:
    return px / dpi * 25.4


def px_to_pt(px: Column, dpi: Column) -> Column:
    return px / dpi * 72.0
