"""Text, figures and photos of a page from its pixels, its read lines and its layout; areas of unions of boxes.

``pixels`` (keys, x, y, gray) are the cells of a page that are not white; a page (keys, w, h, scale) may have any size,
as every step works on rows, tiles and labels. Boxes are in pixels of the read image and come back
divided by ``scale``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import zones
from leafmill.operators.features import FIGURE_LABELS, FURNITURE_LABELS, LEAST_BOX, low_coverage
from leafmill.operators.spatial import labelled_lines

WHITE = 255
PHOTO_AREA, PHOTO_FILL, TEXT_REACH = 0.01, 0.2, 6
PAD_SHARE, PAD_LEAST = 0.01, 3
#: A crop is of continuous tone if so many of its gray bins hold more than BIN_SHARE of it.
BINS, BIN_SHARE, TONES = 32, 0.01, 6
SIDES = ("x0", "y0", "x1", "y1")


def union_areas(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, total, covered: number of boxes (keys, x0, y0, x1, y1), sum of their areas, area of their union.

    A sweep: the distinct x of a page's sides cut it into slabs, a box is in the slabs between its sides, and
    within a slab the boxes in order of y0 each add what lies beyond the furthest y1 so far. Boxes without
    an area count in ``n`` only; boxes with a null side not at all.
    """
    whole = boxes.select(*keys, *SIDES).where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    some = whole.where("x1 > x0 AND y1 > y0")
    edges = some.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("x0", "x1"))))).alias("edges"))
    at = lambda c: F.array_position("edges", F.col(c)).cast("int")
    slabs = some.join(edges, keys).select(*keys, "y0", "y1", "edges", F.explode(F.sequence(at("x0"), at("x1") - 1)).alias("slab"))
    slabs = slabs.select(*keys, "slab", "y0", "y1", (F.element_at("edges", F.col("slab") + 1) - F.element_at("edges", F.col("slab"))).alias("width"))
    before = Window.partitionBy(*keys, "slab").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    more = slabs.withColumn("reach", F.max("y1").over(before)).select(*keys, (F.col("width") * F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", F.coalesce("reach", "y0")))).alias("a"))
    covered = more.groupBy(*keys).agg(F.sum("a").alias("covered"))
    size = whole.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))).alias("total"))
    return size.join(covered, keys, "left").fillna(0.0, ["covered"])


def _box(a, b, c, d):
    return [x.alias(n) for x, n in zip((a, b, c, d), SIDES, strict=True)]


def toned(pixels: DataFrame, boxes: DataFrame, pages: DataFrame, keys: list[str], *, cell: int = 64) -> DataFrame:
    """keys, pos, tones: how many of BINS gray bins hold more than BIN_SHARE of each box (keys, pos, whole-number sides)."""
    cut = boxes.join(pages.select(*keys, "w", "h"), keys).select(*keys, "pos", *_box(F.greatest("x0", F.lit(0)), F.greatest("y0", F.lit(0)), F.least("x1", "w"), F.least("y1", "h")))
    cut = cut.where("x1 > x0 AND y1 > y0").withColumn("size", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    grid = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    placed = cut.withColumn("gx", grid("x0", "x1")).withColumn("gy", grid("y0", "y1"))
    near = pixels.select(*keys, "x", "y", "gray", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    inside = placed.join(near, [*keys, "gx", "gy"]).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    bins = inside.groupBy(*keys, "pos", "size", F.floor(F.col("gray") / (256 // BINS)).alias("bin")).agg(F.count("*").alias("n"))
    held = bins.groupBy(*keys, "pos", "size").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bin") < BINS - 1, (F.col("n") > F.col("size") * BIN_SHARE).cast("int")).otherwise(0)).alias("dark"), F.sum(F.when(F.col("bin") == BINS - 1, F.col("n")).otherwise(0)).alias("light"))
    white = F.col("size") - F.col("n") + F.col("light")
    counted = held.select(*keys, "pos", (F.col("dark") + (white > F.col("size") * BIN_SHARE).cast("int")).cast("long").alias("tones"))
    return cut.select(*keys, "pos").join(counted, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("tones", F.lit(1)).cast("long").alias("tones"))


def figures(pixels: DataFrame, layout: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, kind, whole-number box: layout boxes that are figures; of continuous tone they are photos."""
    wanted = F.col("label").isNull() | (F.col("label").isin(*FIGURE_LABELS) & ~F.col("label").isin(*FURNITURE_LABELS))
    boxes = layout.where(wanted).select(*keys, "pos", *(F.col(c).cast("long").alias(c) for c in SIDES)).where(f"x1 - x0 >= {LEAST_BOX} AND y1 - y0 >= {LEAST_BOX}")
    kind = F.when(F.col("tones") >= TONES, "photo").otherwise("figure")
    return boxes.join(toned(pixels, boxes, pages, keys), [*keys, "pos"], "left").select(*keys, "pos", kind.alias("kind"), *SIDES)


def padded_sides(w, h):
    pad = F.greatest(F.lit(PAD_LEAST), F.floor(PAD_SHARE * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))
    return _box(F.greatest(F.lit(0), F.col("x0") - pad), F.greatest(F.lit(0), F.col("y0") - pad), F.least(w, F.col("x1") + pad), F.least(h, F.col("y1") + pad))


def separated(pixels: DataFrame, pages: DataFrame, lines: DataFrame, layout: DataFrame, keys: list[str], *, threshold: str = "threshold", tile: int = zones.TILE) -> tuple[DataFrame, DataFrame]:
    """(regions, findings) of pages (keys, w, h, scale and the ink ``threshold``).

    Lines (keys, pos, text, conf, box) become text regions with the first fitting layout label; layout boxes (keys,
    pos, label, text, box) become figures or photos, or, as furniture with a text, text regions. What ink is left outside of
    both is labelled: a zone of PHOTO_AREA of the page that fills PHOTO_FILL of its box and stays off the page's
    frame is a photo. ``findings``: keys, ink, lost (ink in none of these), no_text, low_coverage.
    """
    ink = pixels.join(pages.select(*keys, threshold), keys).where(F.col("gray") <= F.col(threshold)).select(*keys, "x", "y")
    shapes = figures(pixels, layout, pages, keys)
    reach = TEXT_REACH
    written = lines.select(*keys, *_box(*(F.col(c).cast("long") + d for c, d in zip(SIDES, (-reach, -reach, reach + 1, reach + 1), strict=True))))
    rest = zones.outside_boxes(ink, shapes.select(*keys, *SIDES).unionByName(written), keys)
    size = zones.measured(zones.labelled(rest, keys, tile=tile), keys).join(pages.select(*keys, "w", "h"), keys)
    inner = (F.col("x0") > 0) & (F.col("y0") > 0) & (F.col("x1") < F.col("w")) & (F.col("y1") < F.col("h"))
    # Quotients of whole numbers meet a share exactly where products of a share with them may not.
    large = (F.col("n") / (F.col("w") * F.col("h")) >= PHOTO_AREA) & (F.col("n") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) >= PHOTO_FILL)
    photos = size.where(inner & large)
    lost = zones.outside_boxes(rest, photos.select(*keys, *SIDES), keys).groupBy(*keys).agg(F.count("*").alias("lost"))
    furniture = layout.where(F.col("label").isin(*FURNITURE_LABELS))
    named = labelled_lines(lines, furniture, keys)
    none = lambda t: F.lit(None).cast(t)
    region = lambda df, kind, source, text, conf, label, box=SIDES: df.select(*keys, kind.alias("kind"), F.lit(source).alias("source"), text.cast("string").alias("ocr_text"), conf.cast("double").alias("ocr_conf"), label.cast("string").alias("layout_label"), *(F.col(c).cast("double").alias(c) for c in box))
    found = region(named, F.lit("text"), "line", F.nullif("text", F.lit("")), F.col("conf"), F.col("label"))
    found = found.unionByName(region(furniture.where("text <> ''"), F.lit("text"), "layout", F.col("text"), none("double"), F.col("label")))
    found = found.unionByName(region(shapes, F.col("kind"), "layout", none("string"), none("double"), none("string")))
    found = found.unionByName(region(photos.select(*keys, *padded_sides(F.col("w"), F.col("h"))), F.lit("photo"), "residual", none("string"), none("double"), none("string")))
    scaled = found.join(pages.select(*keys, "scale"), keys).select(*keys, "kind", "source", "ocr_text", "ocr_conf", "layout_label", *((F.col(c) / F.greatest("scale", F.lit(1e-6))).alias(c) for c in SIDES))
    total = ink.groupBy(*keys).agg(F.count("*").alias("ink"))
    read = lines.select(*keys).distinct().withColumn("read", F.lit(True))
    counts = pages.select(*keys).join(total, keys, "left").join(lost, keys, "left").join(read, keys, "left").fillna(0, ["ink", "lost"])
    low = F.col("read").isNotNull() & low_coverage(F.col("ink") - F.col("lost"), F.col("ink"))
    return scaled, counts.select(*keys, "ink", "lost", F.col("read").isNull().alias("no_text"), low.alias("low_coverage"))
