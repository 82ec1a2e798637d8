"""Relations of boxes on one page: labels of lines, containment, overlap, deduplication, ranking.

Rows of a page meet through grid cells, not as all pairs of the page: two boxes are compared in the first
cell that both touch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.graph import cut

BOX = ("x0", "y0", "x1", "y1")
SAME_IOU, COVERED, HINT, HOLE, NMS_IOU = 0.3, 0.5, 0.3, 0.15, 0.55
RANKED = 12


def cells(df: DataFrame, size: float) -> DataFrame:
    """``df`` once for each grid cell that its box touches, in columns gx and gy; ``size`` by ``size`` units a cell."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    wide = df.withColumn("gx", F.explode(F.sequence(at("x0"), F.greatest(at("x0"), at("x1")))))
    return wide.withColumn("gy", F.explode(F.sequence(at("y0"), F.greatest(at("y0"), at("y1")))))


def meeting(a: DataFrame, b: DataFrame, keys: list[str], *, cell: float) -> DataFrame:
    """Pairs of boxes of one key that overlap or touch, as structs a and b, each pair once."""
    left = cells(a, cell).select(*keys, "gx", "gy", F.struct(*a.columns).alias("a"))
    right = cells(b, cell).select(*keys, "gx", "gy", F.struct(*b.columns).alias("b"))
    at = lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell).cast("long")
    first = (F.col("gx") == at("x0")) & (F.col("gy") == at("y0"))
    touch = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    return left.join(right, [*keys, "gx", "gy"]).where(touch & first).select(*keys, "a", "b")


def inner_area(a: Column, b: Column) -> Column:
    span = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return span("x0", "x1") * span("y0", "y1")


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def iou(a: Column, b: Column, *, least_union: float = 0.0) -> Column:
    """Shared over joint area; ``least_union`` 1 is the variant for pixel boxes, whose union counts at least 1."""
    inner = inner_area(a, b)
    union = area(a) + area(b) - inner
    if least_union:
        return F.when(inner > 0, inner / F.greatest(union, F.lit(least_union))).otherwise(0.0)
    return F.when(union > 0, inner / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def centre_inside(a: Column, b: Column) -> Column:
    cx, cy = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return (cx >= b["x0"]) & (cx <= b["x1"]) & (cy >= b["y0"]) & (cy <= b["y1"])


def labelled_lines(lines: DataFrame, layout: DataFrame, keys: list[str], *, cell: float = 256.0) -> DataFrame:
    """``lines`` (keys, pos, box) with ``label`` of the first layout box (keys, pos, label, box) that holds their centre or
    has an IoU of SAME_IOU; null if none."""
    match = meeting(lines, layout, keys, cell=cell).where(centre_inside(F.col("a"), F.col("b")) | (iou(F.col("a"), F.col("b")) >= SAME_IOU))
    first = match.groupBy(*keys, F.col("a.pos").alias("pos")).agg(F.min_by(F.col("b.label"), F.col("b.pos")).alias("label"))
    return lines.join(first, [*keys, "pos"], "left")


def uncovered(rects: DataFrame, fills: DataFrame, keys: list[str], *, cell: float = 256.0) -> DataFrame:
    """``rects`` (keys, pos, box) of which no fill covers more than COVERED of their own area."""
    over = meeting(rects, fills, keys, cell=cell).where(inner_area(F.col("a"), F.col("b")) > COVERED * F.greatest(area(F.col("a")), F.lit(1.0)))
    return rects.join(over.select(*keys, F.col("a.pos").alias("pos")).distinct(), [*keys, "pos"], "left_anti")


def hinted(shapes: DataFrame, hints: DataFrame, keys: list[str], *, cell: float = 256.0) -> DataFrame:
    """keys, shape, hint: pairs that share HINT of the smaller one's area, and hints that no shape has, with a null shape."""
    pair = meeting(shapes, hints, keys, cell=cell)
    small = F.greatest(F.least(area(F.col("a")), area(F.col("b"))), F.lit(1e-9))
    found = pair.where(inner_area(F.col("a"), F.col("b")) / small >= HINT).select(*keys, F.col("a.pos").alias("shape"), F.col("b.pos").alias("hint"))
    rest = hints.withColumnRenamed("pos", "hint").join(found.select(*keys, "hint").distinct(), [*keys, "hint"], "left_anti")
    return found.unionByName(rest.select(*keys, F.lit(None).cast(found.schema["shape"].dataType).alias("shape"), "hint"))


def over_text(holes: DataFrame, texts: DataFrame, keys: list[str], *, cell: float = 256.0) -> DataFrame:
    """``holes`` that share HOLE of the smaller area with some text box."""
    small = F.greatest(F.least(area(F.col("a")), area(F.col("b"))), F.lit(1e-9))
    hit = meeting(holes, texts, keys, cell=cell).where(inner_area(F.col("a"), F.col("b")) / small >= HOLE)
    return holes.join(hit.select(*keys, F.col("a.pos").alias("pos")).distinct(), [*keys, "pos"], "left_semi")


def first_copies(rows: DataFrame, keys: list[str], same: str) -> DataFrame:
    """The first row in ``pos`` order of each box (to a tenth, half to even) and ``same`` value."""
    rounded = [F.bround(c, 1) for c in BOX]
    w = Window.partitionBy(*keys, *rounded, same).orderBy("pos")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def distinct_boxes(boxes: DataFrame, keys: list[str], *, cell: float = 256.0, rounds: int = 1000) -> DataFrame:
    """Boxes (keys, pos, box) in order of y0, x0, area and pos, each kept unless it overlaps an earlier kept one by an IoU over NMS_IOU.

    Only boxes that overlap so much are looked at together. A round drops those with a kept earlier one
    and keeps those all of whose earlier ones are dropped; it ends when none is open, so there are as many rounds as
    the longest chain of overlaps that hang on each other.
    """
    order = lambda b: F.struct(F.col(f"{b}.y0"), F.col(f"{b}.x0"), ((F.col(f"{b}.x1") - F.col(f"{b}.x0")) * (F.col(f"{b}.y1") - F.col(f"{b}.y0"))).alias("area"), F.col(f"{b}.pos"))
    pair = meeting(boxes, boxes, keys, cell=cell).where(order("a") < order("b")).where(iou(F.col("a"), F.col("b"), least_union=1.0) > NMS_IOU)
    open_ = cut(pair.select(*keys, F.col("a.pos").alias("before"), F.col("b.pos").alias("pos")).distinct())
    dropped = None
    for _ in range(rounds):
        if open_.isEmpty():
            break
        # Whatever has no open or kept one before it is kept, and what comes after such a one is dropped.
        free = open_.select(*keys, F.col("before").alias("pos")).distinct().join(open_.select(*keys, "pos").distinct(), [*keys, "pos"], "left_anti")
        gone = cut(open_.join(free.withColumnRenamed("pos", "before"), [*keys, "before"], "left_semi").select(*keys, "pos").distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        rest = open_.join(gone, [*keys, "pos"], "left_anti").join(gone.withColumnRenamed("pos", "before"), [*keys, "before"], "left_anti")
        open_ = cut(rest.select(*keys, "before", "pos"))
    else:
        raise RuntimeError(f"overlaps hang on each other over more than {rounds} rounds")
    return boxes if dropped is None else boxes.join(dropped, [*keys, "pos"], "left_anti").select(*boxes.columns)


def ranked_candidates(boxes: DataFrame, keys: list[str], *, most: int = RANKED) -> DataFrame:
    """Of each half of a page (page_w, page_h columns) the ``most`` likeliest number boxes, with band and rank.

    By the distance from the edge, the height against a hundredth of the page, the distance from the next of
    centre and sides, and the area.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    low = cy > F.col("page_h") / 2
    edge = F.when(low, F.col("page_h") - cy).otherwise(cy)
    anchor = F.least(F.abs(cx - F.col("page_w") / 2), cx, F.col("page_w") - cx)
    order = [edge, F.abs(F.col("y1") - F.col("y0") - 0.010 * F.col("page_h")), F.least(anchor, 0.18 * F.col("page_w")), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("pos")]
    named = boxes.withColumn("band", F.when(low, "bottom").otherwise("top"))
    w = Window.partitionBy(*keys, "band").orderBy(*order)
    return named.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def clamped(b: Column, page_w: Column, page_h: Column) -> Column:
    fit = lambda c, of: F.greatest(F.lit(0.0), F.least(of, b[c]))
    return F.struct(*(fit(c, (page_w if c[0] == "x" else page_h).cast("double")).alias(c) for c in BOX))


def padded(b: Column, share: float = 0.01, least: int = 3) -> Column:
    """A box grown on all sides by ``share`` of its longer side, whole pixels, ``least`` at least."""
    pad = F.greatest(F.lit(least), F.floor(share * F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"])).cast("int"))
    return F.struct(*((b[c] + (pad if c[1] == "1" else -pad)).cast("double").alias(c) for c in BOX))


def corner_probes(content: Column, page_w: Column, page_h: Column) -> Column:
    """Two boxes near the top outer corners, where faint numbers may stand."""
    w, h = page_w.cast("double"), page_h.cast("double")
    pw, ph = F.greatest(F.lit(28.0), F.least(F.lit(46.0), w * 0.020)), F.greatest(F.lit(32.0), F.least(F.lit(54.0), h * 0.016))
    y0 = F.greatest(F.lit(0.0), F.least(h * 0.026, content["y0"] - ph * 0.60))
    y1, inset = F.least(h, y0 + ph), F.greatest(F.lit(92.0), w * 0.055)
    one = lambda x0, x1: clamped(F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")), w, h)
    return F.array(one(inset, inset + pw), one(w - inset - pw, w - inset))


def centre_fraction(b: Column, page_w: Column, page_h: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2 / page_w).alias("fx"), ((b["y0"] + b["y1"]) / 2 / page_h).alias("fy"))


def mirrored(fx: Column) -> Column:
    """Distance of a place from the nearer side: outer corners of left and right pages are one place."""
    return F.least(fx, 1 - fx)


def nearest_centre(value: Column, centres: Column) -> Column:
    """Place, from 0, of the nearest of an array of numbers; the first of equals."""
    d = F.transform(centres, lambda c: F.abs(c - value))
    return F.array_position(d, F.array_min(d)) - 1


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def place_clusters(cands: DataFrame, *, near_x: float, near_y: float) -> DataFrame:
    """``cands`` (doc, i, ord, band, v, fx, fy and more) with ``x`` (mirrored) and ``cluster``, the number of their place in doc and band.

    In order of page and ``ord`` a candidate joins the place whose mean so far is nearest, the first of equals, if both
    distances are within reach, and moves the mean; else it opens a place. An array of places is carried along one
    array of candidates, so a band of a book is one row.
    """
    row = F.struct("i", "ord", mirrored(F.col("fx")).alias("x"), F.col("fy").alias("y"), F.struct(*cands.columns).alias("row"))
    runs = cands.where("v IS NOT NULL").groupBy("doc", "band").agg(F.array_sort(F.collect_list(row)).alias("run"))
    place = "struct<x:double,y:double,n:int>"
    start = F.struct(F.array().cast(f"array<{place}>").alias("places"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, e: Column) -> Column:
        dx, dy = (lambda p: F.abs(e["x"] - p["x"])), (lambda p: F.abs(e["y"] - p["y"]))
        away = F.transform(s["places"], lambda p: F.when((dx(p) <= near_x) & (dy(p) <= near_y), dx(p) / near_x + dy(p) / near_y))
        found = _let(away, lambda d: F.coalesce(F.array_position(d, F.array_min(d)), F.lit(0)).cast("int"))

        def moved(k: Column) -> Column:
            mean = lambda p: F.struct((p["x"] + (e["x"] - p["x"]) / (p["n"] + 1)).alias("x"), (p["y"] + (e["y"] - p["y"]) / (p["n"] + 1)).alias("y"), (p["n"] + 1).alias("n"))
            joined = F.transform(s["places"], lambda p, j: F.when(j + 1 == k, mean(p)).otherwise(p))
            new = F.concat(s["places"], F.array(F.struct(e["x"], e["y"], F.lit(1).alias("n")).cast(place)))
            opened = F.when(k == 0, F.size(s["places"]) + 1).otherwise(k)
            return F.struct(F.when(k == 0, new).otherwise(joined).alias("places"), F.concat(s["at"], F.array(opened)).alias("at"))

        return _let(found, moved)

    numbered = runs.withColumn("at", F.aggregate("run", start, step, lambda s: s["at"]))
    each = numbered.select(F.explode(F.arrays_zip("run", "at")).alias("z"))
    return each.select("z.run.row.*", F.col("z.run.x").alias("x"), F.col("z.at").alias("cluster"))


def position_clusters(cands: DataFrame, *, near_x: float = 0.055, near_y: float = 0.030, least: int = 3, least_offset: int = 2) -> DataFrame:
    """``cands`` (doc, i, ord, band, kind, v, fx, fy) of each book's best place: of those on ``least`` pages, whose most common offset
    (kind and v - i) is on ``least_offset``, the one with the highest four times that offset's pages plus its pages less
    twenty times its spread, if above 0; of equals the one opened first.
    """
    key = ["doc", "band", "cluster"]
    all_ = place_clusters(cands, near_x=near_x, near_y=near_y)
    offset = all_.groupBy(*key, "kind", (F.col("v") - F.col("i")).alias("off")).agg(F.count_distinct("i").alias("n")).groupBy(*key).agg(F.max("n").alias("support"))
    spread = F.max("x") - F.min("x") + F.max("fy") - F.min("fy")
    size = all_.groupBy(*key).agg(F.count_distinct("i").alias("pages"), spread.alias("spread"), F.min(F.struct("i", "ord")).alias("first"))
    score = 4.0 * F.col("support") + F.col("pages") - 20.0 * F.col("spread")
    fit = size.join(offset, key).where((F.col("pages") >= least) & (F.col("support") >= least_offset)).withColumn("score", score).where("score > 0")
    rank = Window.partitionBy("doc").orderBy(F.desc("score"), "first", "band")
    top = fit.withColumn("__r", F.row_number().over(rank)).where("__r = 1").select(*key)
    return all_.join(top, key, "left_semi").select(*cands.columns)


def best_of(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row with the highest ``score`` of each key, the first in ``order`` of equals; null scores come last."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
