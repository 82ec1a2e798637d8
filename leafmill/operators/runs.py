"""The verbs of the engine as chains of operators: analyse page images, normalise margins again, apply a learned model.

Images are read once, by ``analysed``; every later step works on narrow columns. Book statistics are always of
the whole book, also where only some pages are wanted: choose pages after these steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import features, folio_resolve, learn, margins, rasters, robust

KEY = ["doc", "page_index"]
SKEWED, NOT_FOUND, INCONSISTENT, SCALED = "deskew_low_confidence", "margin_not_found", "margin_inconsistent_with_neighbors", "content_scaled_down_to_match_book"


def analysed(images: DataFrame) -> DataFrame:
    """One row a page of images: deskew, content and number box, blankness, flags, review status.

    Flags are of the page among its book: skew and content boxes that stand out, and no text on pages with ink.
    """
    deskew, found, ink = rasters.deskewed(images), rasters.contents(images), rasters.ink(images)
    size = images.select(*KEY, "dpi", F.col("width").cast("double").alias("page_w"), F.col("height").cast("double").alias("page_h"))
    deskew = deskew.withColumnsRenamed({"confidence": "deskew_conf"})
    page = size.join(deskew, KEY).join(found, KEY).join(ink.select(*KEY, "threshold", "ink"), KEY)
    skewed = robust.skew_flags(deskew, ["doc"], "angle", "deskew_conf").select(*KEY, F.lit(True).alias("skewed"))
    page = margins.align_margins(page).join(skewed, KEY, "left")
    blank = F.coalesce(F.col("ink") < features.BLANK_INK, F.lit(False))
    flags = features.with_flag(F.array().cast("array<string>"), SKEWED, F.col("skewed") & ~blank)
    flags = F.when(F.col("margin_flag").isNotNull() & ~blank, F.array_union(flags, F.array("margin_flag"))).otherwise(flags)
    return page.withColumns({"blank": blank, "flags": flags}).withColumn("review_status", features.status_of(F.col("flags"))).drop("skewed", "margin_flag")


def renormalised(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """``pages`` (the columns of ``margins``, flags) with crop, target_w, target_h and the scaled-down flag set anew from stored boxes."""
    body = pages.drop("crop", "target_w", "target_h").join(margins.body_boxes(pages, regions), KEY, "left")
    crops = margins.normalise(body.withColumn("body", F.coalesce("body", "content"))).drop("crop_w", "crop_h")
    out = body.drop("body").join(crops, KEY, "left")
    return out.withColumn("flags", features.with_flag(features.without_flag(F.col("flags"), SCALED), SCALED, F.col("scaled_down"))).drop("scaled_down")


def numbered(pages: DataFrame, cands: DataFrame) -> DataFrame:
    """``pages`` (doc, i, page_index, page_w, page_h, flags) with number, nombre_text, nombre and the gap flag; a page without a place has no number box."""
    resolved = folio_resolve.resolve(pages, cands)
    held = pages.drop("number", "nombre_text", "nombre").join(resolved.select("doc", "i", "number", F.col("text").alias("nombre_text"), F.col("box").alias("nombre")), ["doc", "i"])
    return folio_resolve.with_gap_flags(held, folio_resolve.gap_warnings(resolved))


def learned(pages: DataFrame, model: DataFrame) -> DataFrame:
    """Nested ``pages`` with the page kind that a model of learner features is sure of, else the borderline flag."""
    f = features.learner_features(pages)
    v = f.select("doc_id", "page_index", F.array(*features.LEARNER_FIELDS).alias("v"))
    guess = learn.classify(v, model, "label", "v").select("doc_id", "page_index", "predicted", "confidence")
    out = pages.join(guess, ["doc_id", "page_index"], "left").withColumn("__a", learn.applied(F.col("page_kind"), F.col("flags"), F.col("predicted"), F.col("confidence")))
    return out.select(*(F.col(f"__a.{c}").alias(c) if c in ("page_kind", "flags") else F.col(c) for c in pages.columns))
