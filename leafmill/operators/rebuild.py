"""Whole runs over a store: analysing images into it, and rebuilding what is derived for the books that changed and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import features, runs
from leafmill.operators.graph import cut
from leafmill.operators.store import Store, decoded, encoded

BOXES = ("content", "confidence", "page_w", "page_h")


def with_margins(pages: DataFrame) -> DataFrame:
    """Nested ``pages`` (PAGE_SCHEMA) of whole books with crop, target size, scaled-down flag and status worked out from their stored boxes."""
    m = F.col("margin")
    flat = pages.select(F.col("doc_id").alias("doc"), "page_index", "dpi", "flags", *(m[c].alias(c) for c in BOXES), m["nombre_box"].alias("nombre"))
    regions = pages.select(F.col("doc_id").alias("doc"), "page_index", F.explode("regions").alias("r")).select("doc", "page_index", "r.kind", "r.box.*")
    new = runs.renormalised(flat, regions).select(F.col("doc").alias("doc_id"), "page_index", F.col("flags").alias("__flags"), "crop", "target_w", "target_h")
    held = pages.join(new, ["doc_id", "page_index"], "left")
    margin = F.when(m.isNotNull(), m.withField("crop", F.col("crop")).withField("target_w", F.col("target_w")).withField("target_h", F.col("target_h")))
    reviewed = F.col("review_status").isin("approved", "corrected")
    flags = F.coalesce("__flags", "flags")
    of = {"margin": margin, "flags": flags, "review_status": F.when(reviewed, F.col("review_status")).otherwise(features.status_of(F.coalesce(flags, F.array().cast("array<string>"))))}
    return held.select(*(of[c].alias(c) if c in of else F.col(c) for c in pages.columns))


def rebuilt(store: Store, *, since: int, at: float) -> tuple[DataFrame, int]:
    """(changed pages, version): margins of every book of which a page changed after version ``since`` of ``pages``.

    The change feed names the books, their files alone are read, whole books are worked out, as margins are statistics of
    a book, and pages whose row is another one now are merged with the time ``at``. The version is that of the
    pages that were read: give it as ``since`` next time, and commits that came meanwhile are seen then.
    """
    log = store.log("pages")
    now = log.snapshot()
    books = store.changes("pages", since, now.version).select("doc_id").distinct()
    held = store._read("pages", now.files(log.touched(since, now.version))).join(books, "doc_id", "left_semi")
    new = encoded(with_margins(decoded(held))).withColumn("updated_at", F.lit(at))
    rest = [c for c in new.columns if c != "updated_at"]
    old = encoded(decoded(held)).select(*rest)
    changed = new.join(old.select(*(F.col(c).alias(f"__{c}") for c in rest)), (F.col("doc_id") == F.col("__doc_id")) & (F.col("page_index") == F.col("__page_index")))
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return changed.where(~same).select(*new.columns), now.version


def rebuild(store: Store, *, since: int, at: float) -> int:
    """Runs ``rebuilt`` and merges its pages; the version to go on from."""
    changed, version = rebuilt(store, since=since, at=at)
    store.merge("pages", changed, "updated_at")
    return version


def nested(analysed: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of ``runs.analysed`` and their regions (doc, page_index, kind, source, ocr_text, ocr_conf, layout_label, box sides) as pages (PAGE_SCHEMA)."""
    of = F.struct(
        "kind", F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).alias("box"), "source", "ocr_text", F.col("ocr_conf").cast("double").alias("ocr_conf"),
        F.lit(None).cast("string").alias("tone"), "layout_label",
    )
    held = regions.groupBy("doc", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", of.alias("r")))), lambda x: x["r"]).alias("regions"))
    p = analysed.join(held, ["doc", "page_index"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    columns = {
        "doc_id": F.col("doc"), "page_index": F.col("page_index").cast("int"), "source": F.struct(F.col("doc"), F.col("page_index"), none("string"), F.lit(1.0)), "dpi": F.col("dpi"),
        "deskew": F.struct("angle", "deskew_conf"), "margin": F.struct("content", "confidence", "nombre", none(features.BOX_SCHEMA), "page_w", "page_h", none("double"), none("double")),
        "regions": F.coalesce("regions", F.array().cast(f"array<{features.REGION_SCHEMA}>")), "page_kind": F.lit("auto"), "flags": F.col("flags"), "review_status": F.col("review_status"),
        "decided_by": F.lit("auto"), "nombre_text": none("string"), "page_number": none("int"), "blank": F.col("blank"),
    }
    kinds = {f.name: f.dataType for f in analysed.sparkSession.createDataFrame([], features.PAGE_SCHEMA).schema}
    return p.select(*(columns[c].cast(kinds[c]).alias(c) for c in kinds))


def run(store: Store, images: DataFrame, regions: DataFrame, *, at: float) -> int:
    """Analyses ``images`` (the pages of a scan), normalises margins a book, and persists pages, page features and region features; the version of ``pages``.

    Any number of runs may write into one store at a time: each replaces the books that it has read.
    """
    pages = cut(with_margins(nested(runs.analysed(images), regions)))
    sized = pages.withColumns({"page_w": F.col("margin.page_w"), "page_h": F.col("margin.page_h")})
    store.replace("page_feature", features.page_features(sized).withColumnRenamed("doc_id", "book_id"))
    store.replace("region_feature", features.region_features(sized).withColumnRenamed("doc_id", "book_id"))
    return store.merge("pages", encoded(pages).withColumn("updated_at", F.lit(at)), "updated_at")
