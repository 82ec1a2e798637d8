"""Page and region features, book profiles, and the predicates and flags of a page.

``pages`` is one row a page with the nested columns of PAGE_SCHEMA; feature tables are flat and normalised
by page size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
BOX_SCHEMA = "struct<x0:double,y0:double,x1:double,y1:double>"
REGION_SCHEMA = f"struct<kind:string,box:{BOX_SCHEMA},source:string,ocr_text:string,ocr_conf:double,tone:string,layout_label:string>"
PAGE_SCHEMA = (
    "doc_id string, page_index int, source struct<path:string,page_index:int,embedded_image_id:string,ocr_scale:double>, dpi double, "
    "deskew struct<angle_deg:double,confidence:double>, "
    f"margin struct<content:{BOX_SCHEMA},confidence:double,nombre_box:{BOX_SCHEMA},crop:{BOX_SCHEMA},page_w:double,page_h:double,target_w:double,target_h:double>, "
    f"regions array<{REGION_SCHEMA}>, page_kind string, flags array<string>, review_status string, decided_by string, nombre_text string, page_number int, blank boolean"
)
#: Values of the enumerations, fixed.
PAGE_KINDS = ("auto", "bw", "gray", "color", "mrc")
REGION_KINDS = ("text", "figure", "photo")
STATUSES = ("auto", "needs_review", "approved", "corrected")
FIGURE_LABELS = ("figure", "chart", "table", "photo", "advertisement")
FURNITURE_LABELS = ("page_number", "running_head")
NO_TEXT, BORDERLINE, LOW_COVERAGE = "no_text_detected", "page_kind_borderline", "ocr_low_coverage"
STRUCT_GAP, TALL, WIDE, LEAST_LINES, LEAST_SIDE, SIDES_APART = 3, 1.2, 0.8, 5, 3, 0.2
SAMPLE_EVERY = 25
BLANK_INK, LEAST_COVERAGE, LEAST_CONTENT, LEAST_BOX = 0.001, 0.3, 0.12, 4


def share(x: Column, of: Column) -> Column:
    """``x / of``; 0 where the size is not positive."""
    return F.when(of > 0, x / of).otherwise(F.when(x.isNotNull(), 0.0))


def page_features(pages: DataFrame) -> DataFrame:
    """One flat row a page: no text, boxes as shares of the page's width and height."""
    m = lambda c: F.col(f"margin.{c}")
    w, h = F.col("page_w"), F.col("page_h")
    read = F.exists("regions", lambda r: F.coalesce(r["ocr_text"], F.lit("")) != "")
    return pages.select(
        "doc_id", "page_index", F.coalesce(read, F.lit(False)).alias("is_ocr"), F.coalesce(F.size("regions"), F.lit(0)).alias("region_count"),
        F.col("deskew.angle_deg").alias("deskew_angle"), F.col("deskew.confidence").alias("deskew_conf"),
        share(m("content.x1") - m("content.x0"), w).alias("content_w"), share(m("content.y1") - m("content.y0"), h).alias("content_h"),
        F.col("page_number").alias("nombre_value"), share((m("nombre_box.x0") + m("nombre_box.x1")) / 2, w).alias("nombre_cx"),
        share((m("nombre_box.y0") + m("nombre_box.y1")) / 2, h).alias("nombre_cy"), "blank", "page_w", "page_h",
    )


def region_features(pages: DataFrame) -> DataFrame:
    """One flat row a region, in page order ``pos``."""
    each = pages.select("doc_id", "page_index", "page_w", "page_h", F.posexplode("regions").alias("pos", "r"))
    w, h = F.col("page_w"), F.col("page_h")
    return each.select("doc_id", "page_index", "pos", F.col("r.kind").alias("cls"), *(share(F.col(f"r.box.{c}"), w if c[0] == "x" else h).alias(c) for c in ("x0", "y0", "x1", "y1")), F.col("r.ocr_conf").alias("conf"), F.col("r.source").alias("source"))


def learner_features(pages: DataFrame) -> DataFrame:
    """doc_id, page_index and the learner's vector as columns: angle, confidences, counts, share of photo area."""
    of = lambda k: F.filter("regions", lambda r: r["kind"] == k)
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    photo = F.aggregate(of("photo"), F.lit(0.0), lambda s, r: s + area(r["box"]))
    content = F.coalesce(area(F.col("margin.content")), F.lit(0.0))
    return pages.select(
        "doc_id", "page_index", F.col("deskew.angle_deg").alias("angle"), F.col("deskew.confidence").alias("deskew_conf"), F.coalesce("margin.confidence", F.lit(0.0)).alias("margin_conf"),
        F.size(of("text")).cast("double").alias("n_text"), F.size(of("photo")).cast("double").alias("n_photo"), (photo / F.greatest(content, F.lit(1.0))).alias("photo_area"),
    )


LEARNER_FIELDS = ("angle", "deskew_conf", "margin_conf", "n_text", "n_photo", "photo_area")


def vector(features: Column | str, fields: tuple[str, ...] = LEARNER_FIELDS) -> Column:
    """A map of features as an array in fixed order; missing ones are 0."""
    f = F.col(features) if isinstance(features, str) else features
    return F.array(*[F.coalesce(F.try_element_at(f, F.lit(k)).cast("double"), F.lit(0.0)) for k in fields])


def reading_text(regions: Column) -> Column:
    """Texts of the regions in their order, joined."""
    return F.array_join(F.transform(regions, lambda r: r["ocr_text"]), "")


def robust(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``by`` and for each value a struct(median, mad, n), null without any value."""
    mid = df.groupBy(*by).agg(*(F.median(v).alias(f"__m_{v}") for v in values), *(F.count(v).alias(f"__n_{v}") for v in values))
    off = df.join(mid, by).groupBy(*by).agg(*((MAD_SCALE * F.median(F.abs(F.col(v) - F.col(f"__m_{v}")))).alias(f"__d_{v}") for v in values))
    return mid.join(off, by).select(*by, *(F.when(F.col(f"__n_{v}") > 0, F.struct(F.col(f"__m_{v}").alias("median"), F.col(f"__d_{v}").alias("mad"), F.col(f"__n_{v}").alias("n"))).alias(v) for v in values))


def dominant_offset(features: DataFrame) -> DataFrame:
    """doc_id, dominant_offset: the most frequent printed number less page index, the first seen of equals."""
    each = features.where("nombre_value is not null").withColumn("off", (F.col("nombre_value") - F.col("page_index")).cast("long"))
    counts = each.groupBy("doc_id", "off").agg(F.count("*").alias("c"), F.min("page_index").alias("first"))
    return counts.groupBy("doc_id").agg(F.max_by("off", F.struct("c", -F.col("first"))).alias("dominant_offset"))


def class_density(features: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, cls, regions, density: regions of a class a page of the book."""
    pages = features.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return regions.groupBy("doc_id", "cls").agg(F.count("*").alias("regions")).join(pages, "doc_id").select("doc_id", "cls", "regions", (F.col("regions") / F.col("pages")).alias("density"))


def writing_direction(regions: DataFrame) -> DataFrame:
    """doc_id, writing_dir by the median shape of text regions: vertical, horizontal or unknown."""
    shape = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    fit = (F.col("cls") == "text") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    each = regions.groupBy("doc_id").agg(F.count(F.when(fit, 1)).alias("n"), F.median(F.when(fit, shape)).alias("m"))
    way = F.when(F.col("n") < LEAST_LINES, "unknown").when(F.col("m") > TALL, "vertical").when(F.col("m") < WIDE, "horizontal").otherwise("unknown")
    return each.select("doc_id", way.alias("writing_dir"))


def binding_side(features: DataFrame, directions: DataFrame) -> DataFrame:
    """doc_id, binding: by the side on which even and odd pages have their number, else by writing direction."""
    at = lambda p: F.when(F.pmod("page_index", F.lit(2)) == p, F.col("nombre_cx"))
    each = features.groupBy("doc_id").agg(F.median(at(0)).alias("e"), F.median(at(1)).alias("o"), F.count(at(0)).alias("ne"), F.count(at(1)).alias("no"))
    sure = (F.least("ne", "no") >= LEAST_SIDE) & (F.abs(F.col("e") - F.col("o")) > SIDES_APART)
    side = F.when(sure, F.when(F.col("e") < F.col("o"), "right").otherwise("left")).when(F.col("writing_dir") == "vertical", "right").when(F.col("writing_dir") == "horizontal", "left").otherwise("unknown")
    return each.join(directions, "doc_id", "left").select("doc_id", side.alias("binding"))


def book_profile(features: DataFrame, regions: DataFrame) -> DataFrame:
    """One row a book: counts, robust sizes, dominant offset, densities as a map, writing direction, binding."""
    counts = features.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.count(F.when(F.col("is_ocr"), 1)).alias("ocr_pages"))
    stats = robust(features, ["doc_id"], ["page_w", "page_h", "deskew_angle", "content_w", "content_h"])
    density = class_density(features, regions).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cls", "density")))).alias("class_density"))
    directions = writing_direction(regions)
    out = counts.join(stats, "doc_id").join(dominant_offset(features), "doc_id", "left").join(density, "doc_id", "left").join(directions, "doc_id", "left")
    return out.join(binding_side(features, directions), "doc_id", "left").withColumn("writing_dir", F.coalesce("writing_dir", F.lit("unknown")))


def body_run(features: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, front_end, body_end: the longest run of pages with the dominant offset, the earliest of equals.

    Pages without a number never break a run; STRUCT_GAP pages of other offsets do.
    """
    numbered = features.where("nombre_value is not null").join(offsets.where("dominant_offset is not null"), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("page_index")
    on = numbered.withColumn("on", F.col("nombre_value") - F.col("page_index") == F.col("dominant_offset"))
    on = on.withColumn("off_so_far", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    fresh = F.coalesce((F.col("off_so_far") - F.lag("off_so_far").over(w) >= STRUCT_GAP).cast("int"), F.lit(1))
    run = on.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = run.groupBy("doc_id", "run").agg(F.count("*").alias("c"), F.min("page_index").alias("front_end"), F.max("page_index").alias("body_end"))
    best = runs.groupBy("doc_id").agg(F.max_by(F.struct("front_end", "body_end"), F.struct("c", -F.col("front_end"))).alias("b"))
    return features.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", "b.front_end", "b.body_end")


def representative(pages: DataFrame) -> DataFrame:
    """doc_id, page_index of the flagged pages and of every SAMPLE_EVERY-th page of a book, once each."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1
    return pages.withColumn("__at", at).where((F.size("flags") > 0) | (F.col("__at") % SAMPLE_EVERY == 0)).select("doc_id", "page_index").distinct()


def with_flag(flags: Column, flag: str, when: Column) -> Column:
    """``flags`` with ``flag`` once where ``when``; unknown conditions add nothing."""
    held = F.coalesce(flags, F.array().cast("array<string>"))
    return F.when(F.coalesce(when, F.lit(False)), F.array_union(held, F.array(F.lit(flag)))).otherwise(held)


def without_flag(flags: Column, flag: str) -> Column:
    return F.array_remove(F.coalesce(flags, F.array().cast("array<string>")), flag)


def status_of(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, "needs_review").otherwise("auto")


def review_queue(pages: DataFrame, doc: str | None = None) -> DataFrame:
    """Pages that wait for review, in order; of one book if ``doc`` is given."""
    held = pages.where("review_status = 'needs_review'")
    return (held if doc is None else held.where(F.col("doc_id") == doc)).orderBy("doc_id", "page_index")


def blank_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (is_ocr, region_count, ink, flags) with ``blank``: read, no regions, next to no ink; such pages lose the no-text flag."""
    blank = F.col("is_ocr") & (F.col("region_count") == 0) & (F.col("ink") < BLANK_INK)
    return pages.withColumn("blank", F.coalesce(blank, F.lit(False))).withColumn("flags", F.when(F.col("blank"), without_flag(F.col("flags"), NO_TEXT)).otherwise(F.col("flags")))


def content_or_page(content: Column, region_count: Column, page_w: Column, page_h: Column, confidence: Column) -> Column:
    """struct(content, confidence): a small box without regions gives way to the whole page, confidence 0."""
    small = (region_count == 0) & ((content["x1"] - content["x0"]) * (content["y1"] - content["y0"]) < LEAST_CONTENT * page_w * page_h)
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), page_w.cast("double").alias("x1"), page_h.cast("double").alias("y1"))
    return F.when(small, F.struct(whole.alias("content"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(content.alias("content"), confidence.cast("double").alias("confidence")))


def low_coverage(covered: Column, total: Column) -> Column:
    return F.coalesce((total > 0) & (covered / F.nullif(total, F.lit(0)) < LEAST_COVERAGE), F.lit(False))


def figure_boxes(layout: Column) -> Column:
    """Layout boxes (label, box) that are figures of LEAST_BOX pixels or more, numbers and running heads left out."""
    return F.filter(layout, lambda b: b["label"].isin(*FIGURE_LABELS) & ~b["label"].isin(*FURNITURE_LABELS) & (b["box"]["x1"] - b["box"]["x0"] >= LEAST_BOX) & (b["box"]["y1"] - b["box"]["y0"] >= LEAST_BOX))


def page_mode(bilevel: Column, photo: Column, colour: Column) -> Column:
    return F.when(bilevel, "bw").when(photo, F.when(colour, "color").otherwise("gray")).otherwise("bw")


def render_mode(page_kind: Column) -> Column:
    return F.when(page_kind.isin("gray", "color"), page_kind).otherwise("bw")


def text_direction(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when(x1 - x0 >= y1 - y0, "h").otherwise("v")


def orientation_fix(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page_w, page_h) with ``turn``: pages that lie across most of a book of three or more."""
    lying = (F.col("page_w") > F.col("page_h")).cast("int")
    book = Window.partitionBy("doc_id")
    n, most = F.count("*").over(book), F.sum(lying).over(book) * 2 > F.count("*").over(book)
    return pages.withColumn("turn", (n >= 3) & ((lying == 1) != most))


def stage_shares(timings: DataFrame) -> DataFrame:
    """stage, seconds, percent of all, most first."""
    each = timings.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    total = each.agg(F.sum("seconds").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("stage", "seconds", F.when(F.col("total") > 0, 100 * F.col("seconds") / F.col("total")).otherwise(0.0).alias("percent")).orderBy(F.desc("seconds"), "stage")


def stride_sample(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Every step-th row of each group in order, the step such that at most ``most`` are left."""
    w = Window.partitionBy(*by)
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / most))
    at = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumns({"__at": at, "__step": step}).where(F.col("__at") % F.col("__step") == 0).drop("__at", "__step")
