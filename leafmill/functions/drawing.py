"""Vector drawing text, colours, units and shape measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control point distance of a quarter circle's cubic curve, for radius 1.
QUARTER = 4 * (math.sqrt(2) - 1) / 3


def px_to_pt(px: Column, dpi: Column) -> Column:
    return px * 72.0 / dpi


def mm_to_px(mm: Column, dpi: Column) -> Column:
    """At 96 dots an inch where the resolution is unknown."""
    return mm / 25.4 * F.when(dpi > 0, dpi).otherwise(96.0)


def fill_rect(x0: Column, y0: Column, x1: Column, y1: Column, gray: Column, page_h_pt: Column, scale: Column) -> Column:
    """Drawing operators of one filled rectangle: pixels from the top left in, points from the bottom left out."""
    left, top = F.least(x0, x1), F.least(y0, y1)
    right, bottom = F.greatest(x0, x1), F.greatest(y0, y1)
    return F.format_string("%.2f g %.2f %.2f %.2f %.2f re f\n", gray, left * scale, page_h_pt - bottom * scale, (right - left) * scale, (bottom - top) * scale)


def _subpath(points: Column, page_h: Column) -> Column:
    """One closed subpath of array<struct<x, y>> whole pixels; null under three points."""
    step = lambda p, i: F.format_string("%d %d %s", p["x"].cast("long"), (page_h - p["y"].cast("long")).cast("long"), F.when(i == 0, "m").otherwise("l"))
    return F.when(F.size(points) >= 3, F.concat(F.array_join(F.transform(points, step), " "), F.lit(" h")))


def contour_path(contour: Column, holes: Column, page_h: Column) -> Column:
    """Drawing operators of a contour and its holes, one a line, for even-odd filling; empty without a contour."""
    outer = _subpath(contour, page_h)
    rest = F.array_compact(F.transform(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), lambda h: _subpath(h, page_h)))
    return F.when(outer.isNull(), "").otherwise(F.concat(F.array_join(F.concat(F.array(outer), rest), "\n"), F.lit("\n")))


def circle_path(cx: Column, cy: Column, r: Column, page_h: Column) -> Column:
    """Drawing operators of a circle as four cubic curves, counter-clockwise from the right."""
    x, y, k = cx, page_h.cast("double") - cy, r * QUARTER
    two = lambda a, b: F.format_string("%.2f %.2f", a, b)
    arc = lambda *pts: F.concat(*[c for a, b in pts for c in (two(a, b), F.lit(" "))], F.lit("c"))
    return F.concat_ws(
        " ", two(x + r, y), F.lit("m"), arc((x + r, y + k), (x + k, y + r), (x, y + r)), arc((x - k, y + r), (x - r, y + k), (x - r, y)),
        arc((x - r, y - k), (x - k, y - r), (x, y - r)), arc((x + k, y - r), (x + r, y - k), (x + r, y)), F.lit("h\n"),
    )


def polygon_measures(points: Column) -> Column:
    """struct(area, perimeter, circularity) of a closed polygon, array<struct<x, y>>; circularity is 0 under a perimeter of 1."""
    after = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.least(F.size(points), F.lit(1))))
    pairs = F.arrays_zip(points.alias("a"), after.alias("b"))
    shoelace = F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2
    round_ = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.sqrt(F.pow(p["a"]["x"] - p["b"]["x"], 2) + F.pow(p["a"]["y"] - p["b"]["y"], 2)))
    return F.struct(shoelace.alias("area"), round_.alias("perimeter"), F.when(round_ < 1, 0.0).otherwise(4 * math.pi * shoelace / F.nullif(round_ * round_, F.lit(0.0))).alias("circularity"))


def hex_colour(b: Column, g: Column, r: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def font_fit(unit_width: Column, box_width: Column, box_height: Column, rates: int = 50) -> Column:
    """The share of the box's height, of ``rates`` even ones, at which a text of ``unit_width`` (at size 1) is nearest to its width."""
    at = lambda i: F.struct(F.abs(unit_width * box_height * (i / float(rates)) - box_width).alias("off"), (i / float(rates)).alias("rate"))
    # The distance falls up to the exact share and rises after it, so the even shares about it are tried, and all where
    # rounding, a zero or a null leaves no such place.
    full = F.try_divide(box_width, unit_width * box_height)
    near = F.array(*(at(F.greatest(F.lit(1), F.least(F.lit(rates), F.floor(full * rates).cast("int") + k))) for k in (-1, 0, 1, 2)))
    tried = F.when((unit_width * box_height > 0) & (F.abs(full) < 1e6), near).otherwise(F.transform(F.sequence(F.lit(1), F.lit(rates)), at))
    return F.array_min(tried)["rate"]
