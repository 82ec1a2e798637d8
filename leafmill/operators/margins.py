"""Body boxes, book-level crop normalisation and outliers of content boxes.

``pages`` has doc, page_index, dpi, confidence, page_w, page_h, content and nombre (boxes as structs, null if
there is none) and body (``body_boxes``). Statistics are of one book; books spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import sequence

SPAN_GAP, DOMINANT, KEPT_SPAN = 0.02, 0.5, 0.25
RELIABLE, PERCENTILE, OUTLIER, SCALED = 0.2, 0.975, 1.3, 1.001
MARGIN_MM, PLAIN_DPI = 5.0, 96.0


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def body_boxes(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """doc, page_index, body: the hull of the text in wide x-spans where one span dominates, else the content box.

    ``regions`` has doc, page_index, kind and a box in columns. Spans merge over gaps of SPAN_GAP of the
    content's width; spans of KEPT_SPAN of it stay if the widest has DOMINANT.
    """
    key = ["doc", "page_index"]
    content = pages.where("content is not null").select(*key, "content", width(F.col("content")).alias("cw"))
    text = regions.where("kind = 'text'").select(*key, "x0", "y0", "x1", "y1").join(content, key).where("cw > 0")
    spans = sequence.merge_intervals(text, [*key, "cw"], "x0", "x1", gap=SPAN_GAP * F.col("cw")).select(*key, F.col("x0").alias("a"), F.col("x1").alias("b"), "cw")
    widest = F.max(F.col("b") - F.col("a")).over(Window.partitionBy(*key))
    kept = spans.withColumn("widest", widest).where((F.col("widest") >= DOMINANT * F.col("cw")) & (F.col("b") - F.col("a") >= KEPT_SPAN * F.col("cw"))).select(*key, "a", "b")
    middle = (F.col("x0") + F.col("x1")) / 2
    near = (middle >= F.col("a") - 1) & (middle <= F.col("b") + 1)
    tall = text.join(kept, key).where(near).groupBy(*key).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    wide = kept.groupBy(*key).agg(F.min("a").alias("x0"), F.max("b").alias("x1"))
    body = wide.join(tall, key).select(*key, box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("body"))
    return content.join(body, key, "left").select(*key, F.coalesce("body", "content").alias("body"))


def align_margins(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, content, confidence) with ``margin_flag``: not found, or far larger than the book's median."""
    mid = pages.groupBy("doc").agg(F.median(width(F.col("content"))).alias("__w"), F.median(height(F.col("content"))).alias("__h"))
    lost = F.col("content").isNull() | (F.coalesce("confidence", F.lit(0.0)) < RELIABLE)
    large = (width(F.col("content")) > OUTLIER * F.col("__w")) | (height(F.col("content")) > OUTLIER * F.col("__h"))
    return pages.join(mid, "doc").withColumn("margin_flag", F.when(lost, "margin_not_found").when(large, "margin_inconsistent_with_neighbors")).drop("__w", "__h")


def layout_statistics(pages: DataFrame, *, margin_mm: float = MARGIN_MM) -> DataFrame:
    """One row a book: whether sizes are inches, body size, margins, the number's place past the body, its sides.

    Only reliable pages count (all, if none is), and of them for all but the sizes those with a number box and a
    page size. ``uni_w``/``uni_h`` are the PERCENTILE of content sizes, for books without such pages.
    """
    have = pages.where("content is not null")
    book = have.groupBy("doc").agg(F.bool_and(F.coalesce(F.col("dpi") > 0, F.lit(False))).alias("inches"), F.bool_or(F.coalesce(F.col("confidence") >= RELIABLE, F.lit(False))).alias("some"))
    held = have.join(book, "doc").where((F.col("confidence") >= RELIABLE) | ~F.col("some"))
    size = lambda px: F.when(F.col("inches"), px / F.col("dpi")).otherwise(px)
    uniform = held.groupBy("doc").agg(F.percentile(size(width(F.col("content"))), F.lit(PERCENTILE)).alias("uni_w"), F.percentile(size(height(F.col("content"))), F.lit(PERCENTILE)).alias("uni_h"))
    n, b = F.col("nombre"), F.col("body")
    stat = held.where(n.isNotNull() & (F.col("page_w") > 0) & (F.col("page_h") > 0))
    middle = (n["x0"] + n["x1"]) / 2
    right = middle > (b["x0"] + b["x1"]) / 2
    stat = stat.select(
        "doc", F.pmod("page_index", F.lit(2)).alias("parity"), size(width(b)).alias("bw"), size(height(b)).alias("bh"),
        F.array(size(b["x0"]), size(F.col("page_w") - b["x1"])).alias("sides"), size(b["y0"]).alias("top"), size(F.col("page_h") - b["y1"]).alias("bottom"),
        (middle / F.col("page_w")).alias("nx"), F.when(right, size(n["x1"] - b["x1"])).otherwise(size(b["x0"] - n["x0"])).alias("d"),
        (((n["y0"] + n["y1"]) / 2 - b["y0"]) / F.when(height(b) == 0, 1.0).otherwise(height(b))).alias("ny"),
    )
    at = lambda p: F.median(F.when(F.col("parity") == p, F.col("nx")))
    one = stat.groupBy("doc").agg(*(F.median(c).alias(c) for c in ("bw", "bh", "top", "bottom", "d", "ny")), at(0).alias("nx0"), at(1).alias("nx1"))
    side = stat.select("doc", F.explode("sides").alias("s")).groupBy("doc").agg(F.median("s").alias("side"))
    default = F.lit(margin_mm / 25.4)
    where = lambda c: F.when(F.col(c) > 0.5, "right").when(F.col(c) <= 0.5, "left")
    return book.join(uniform, "doc").join(one, "doc", "left").join(side, "doc", "left").select(
        "doc", "inches", F.coalesce("bw", "uni_w").alias("body_w"), F.coalesce("bh", "uni_h").alias("body_h"), F.coalesce("side", default).alias("side"),
        F.coalesce("top", default).alias("top"), F.coalesce("bottom", default).alias("bottom"), F.coalesce("d", F.lit(0.0)).alias("d"),
        where("nx0").alias("side0"), where("nx1").alias("side1"), F.coalesce(F.col("ny") > 0.5, F.lit(True)).alias("near_bottom"),
    )


def normalise(pages: DataFrame, *, margin_mm: float = MARGIN_MM) -> DataFrame:
    """doc, page_index, crop, crop_w, crop_h, target_w, target_h, scaled_down of every page with a content box.

    All pages of a book get one target size. A page with a number box is placed by its outer and lower edge,
    others keep their content's place on the page; a reliable page's crop holds its whole content. ``crop_w`` and
    ``crop_h`` are the crop's sizes as they were before its place was added, which rounds them.
    """
    s = layout_statistics(pages, margin_mm=margin_mm)
    p = pages.where("content is not null").join(s, "doc")
    c, n = F.col("content"), F.col("nombre")
    unit = F.when(F.col("inches"), F.col("dpi")).otherwise(1.0)
    margin = margin_mm / 25.4 * F.when(F.col("inches"), F.col("dpi")).otherwise(PLAIN_DPI)
    sure = F.coalesce(F.col("confidence") >= RELIABLE, F.lit(False))
    side = F.when(F.pmod("page_index", F.lit(2)) == 0, F.col("side0")).otherwise(F.col("side1"))
    p = p.withColumns({
        "unit": unit, "margin_px": margin, "sure": sure, "number_side": F.when(n.isNotNull(), side),
        "target_w": (F.col("body_w") + 2 * F.col("side")) * unit, "target_h": (F.col("body_h") + F.col("top") + F.col("bottom")) * unit,
    })
    grown = lambda size, target: F.when(F.col("sure"), F.greatest(F.col(target), size(c) + 2 * F.col("margin_px"))).otherwise(F.col(target))
    p = p.withColumns({"crop_w": grown(width, "target_w"), "crop_h": grown(height, "target_h")})
    sized = (F.col("page_w") > 0) & (F.col("page_h") > 0)
    cx, cy = c["x0"] + width(c) / 2, c["y0"] + height(c) / 2
    share = lambda at, of: F.when(sized, at / F.nullif(F.col(of), F.lit(0.0))).otherwise(0.5)
    fore = (F.col("side") - F.col("d")) * F.col("unit")
    x0 = F.when(F.col("number_side") == "left", n["x0"] - fore).when(F.col("number_side") == "right", n["x1"] + fore - F.col("crop_w")).otherwise(cx - share(cx, "page_w") * F.col("crop_w"))
    low = F.when(F.col("near_bottom"), n["y1"] + F.col("bottom") * F.col("unit") - F.col("crop_h")).otherwise(n["y1"] - F.col("top") * F.col("unit"))
    y0 = F.when(n.isNotNull(), low).otherwise(cy - share(cy, "page_h") * F.col("crop_h"))
    xf = F.when(F.col("number_side").isNotNull(), 0.0).otherwise(F.col("margin_px"))
    yf = F.when(n.isNotNull(), 0.0).otherwise(F.col("margin_px"))
    held = lambda at, lo, hi, room, crop: F.when(F.col("sure"), F.greatest(F.least(at, lo - room), hi + room - F.col(crop))).otherwise(at)
    p = p.withColumns({"cx0": held(x0, c["x0"], c["x1"], xf, "crop_w"), "cy0": held(y0, c["y0"], c["y1"], yf, "crop_h")})
    scaled = (F.col("crop_w") > SCALED * F.col("target_w")) | (F.col("crop_h") > SCALED * F.col("target_h"))
    return p.select("doc", "page_index", box(F.col("cx0"), F.col("cy0"), F.col("cx0") + F.col("crop_w"), F.col("cy0") + F.col("crop_h")).alias("crop"), "crop_w", "crop_h", "target_w", "target_h", scaled.alias("scaled_down"))


def transform(width_px: Column, height_px: Column, angle: Column, crop: Column, target_w: Column, target_h: Column, dpi: Column, target_dpi: float, *, size: tuple[Column, Column] | None = None) -> Column:
    """struct(m, out_w, out_h, scale): the matrix (six numbers, rows of 2 x 3) from original to output pixels.

    The page turns by ``angle`` degrees about its centre, then the crop is scaled to ``target_dpi`` and, where it
    is larger than the target, shrunk and centred in it. ``size`` is the crop's size where it is known better than
    by the difference of its edges: of a crop as large as its target that can be less or more than the target.
    """
    turn = F.radians(angle)
    a, b = F.cos(turn), F.sin(turn)
    cx, cy = width_px / 2.0, height_px / 2.0
    r = [a, b, (1 - a) * cx - b * cy, -b, a, b * cx + (1 - a) * cy]
    base = F.when(dpi > 0, F.lit(float(target_dpi)) / F.nullif(dpi, F.lit(0.0))).otherwise(1.0)
    cw, ch = size or (width(crop), height(crop))
    fitted = (target_w > 0) & (target_h > 0)
    shrink = F.when(fitted, F.least(F.lit(1.0), target_w / cw, target_h / ch)).otherwise(1.0)
    scale = base * shrink
    out_w = F.greatest(F.lit(1.0), F.bround(F.when(fitted, target_w * base).otherwise(cw * scale), 0))
    out_h = F.greatest(F.lit(1.0), F.bround(F.when(fitted, target_h * base).otherwise(ch * scale), 0))
    ex, ey = (F.when(fitted, (out - size * scale) / 2).otherwise(0.0) for out, size in ((out_w, cw), (out_h, ch)))
    # Summed from left to right, as SQL does: sums of doubles depend on it.
    m = [scale * r[0], scale * r[1], scale * r[2] + ex - scale * crop["x0"], scale * r[3], scale * r[4], scale * r[5] + ey - scale * crop["y0"]]
    return F.struct(F.array(*m).alias("m"), out_w.cast("long").alias("out_w"), out_h.cast("long").alias("out_h"), scale.alias("scale"))


def mapped(b: Column, m: Column) -> Column:
    """The hull of a box's four corners under a matrix of six numbers."""
    corners = [(b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [m[0] * x + m[1] * y + m[2] for x, y in corners], [m[3] * x + m[4] * y + m[5] for x, y in corners]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
