"""Further bindings of the driver's tables: nested pages, margins, number candidates, review edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.plans.bindings import b_folio, b_page, b_region, read

PAGE_W, PAGE_H = 1200.0, 10000.0


def b_cand(spark: SparkSession, d: str) -> DataFrame:
    """Two candidates a page: its number in the bottom band (or off its place, or in the top band), and on two of three pages a running head of 11."""
    f = b_folio(spark, d)
    at, book = F.col("page_index"), F.col("book_id")
    shift = (book * 7 + at) % 13
    x = F.when(at % 5 == 4, 500 + shift).when(at % 2 == 0, 850 + shift).otherwise(120 + shift).cast("double")
    y = (950 + (book + at * 3) % 7).cast("double")
    low = F.when(at % 11 == 3, "top").otherwise("bottom")
    main = f.select("book_id", "page_index", F.lit(0).cast("long").alias("ord"), low.alias("band"), "kind", "v", F.col("v").cast("string").alias("text"), x.alias("x0"), y.alias("y0"))
    head = f.where("page_index % 3 <> 0").select("book_id", "page_index", F.lit(1).cast("long").alias("ord"), F.lit("top").alias("band"), F.lit("num").alias("kind"), F.lit(11).cast("long").alias("v"), F.lit("11").alias("text"), F.lit(500.0).alias("x0"), F.lit(50.0).alias("y0"))
    out = main.unionByName(head).withColumns({"doc": F.col("book_id"), "i": F.col("page_index"), "x1": F.col("x0") + 30, "y1": F.col("y0") + 20})
    return out.select("doc", "i", "ord", "band", "kind", "v", "text", "x0", "y0", "x1", "y1")


def b_leaf(spark: SparkSession, d: str) -> DataFrame:
    """The pages of ``b_cand``."""
    return b_page(spark, d).select(F.col("book_id").alias("doc"), F.col("page_index").alias("i"), "page_index", F.lit(1000.0).alias("page_w"), F.lit(1000.0).alias("page_h"))


def b_margin(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 40 books with a content hull, a number box on two of three pages, sizes, resolution, confidence."""
    hull = b_region(spark, d).groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    doc = F.pmod("page", F.lit(40))
    p = hull.withColumn("doc", doc).withColumn("page_index", (F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1).cast("long"))
    nx = F.when(F.col("page_index") % 2 == 0, 40.0).otherwise(1100.0) + F.col("page") % 7
    ny = F.lit(9700.0) + F.col("page") % 5
    box = lambda a, b, c, e: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), e.alias("y1"))
    return p.select(
        "doc", "page_index", "page", F.when(F.col("doc") % 4 != 0, (300 + 100 * (F.col("doc") % 3)).cast("double")).alias("dpi"), ((F.col("page") % 10) / 10).alias("confidence"),
        F.when(F.col("page") % 9 != 0, PAGE_W).alias("page_w"), F.when(F.col("page") % 9 != 0, PAGE_H).alias("page_h"),
        box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("content"), F.when(F.col("page") % 3 != 0, box(nx, ny, nx + 30, ny + 20)).alias("nombre"),
    )


def b_text(spark: SparkSession, d: str, pages: DataFrame) -> DataFrame:
    """The regions of ``b_margin``'s pages; those of return flag R are photos, the rest text."""
    r = b_region(spark, d).select("page", F.when(F.col("kind") == "R", "photo").otherwise("text").alias("kind"), "rid", "x0", "y0", "x1", "y1")
    return r.join(pages.select("page", "doc", "page_index"), "page")


def b_nested(spark: SparkSession, d: str) -> DataFrame:
    """Pages with nested regions: one an order of ``lineitem``, of 40 books."""
    m = b_margin(spark, d)
    kind = F.when(F.col("l_returnflag") == "R", "photo").otherwise("text")
    li = read(spark, d, "lineitem")
    x0, y0 = (F.col("l_partkey") % 800).cast("double"), (F.col("l_suppkey") * 9).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 4 * F.col("l_quantity")).alias("x1"), (y0 + F.col("l_quantity")).alias("y1"))
    region = F.struct(
        F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), kind.alias("kind"), box.alias("box"),
        F.col("l_linestatus").alias("source"), F.col("l_partkey").cast("string").alias("ocr_text"),
        F.col("l_discount").alias("ocr_conf"), F.lit(None).cast("string").alias("tone"), F.lit(None).cast("string").alias("layout_label"),
    )
    r = li.groupBy(F.col("l_orderkey").cast("long").alias("page")).agg(F.sort_array(F.collect_list(region)).alias("rs"))
    plain = F.transform("rs", lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "box", "source", "ocr_text", "ocr_conf", "tone", "layout_label"))))
    null_box = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    margin = F.struct(
        "content", "confidence", F.col("nombre").alias("nombre_box"), null_box.alias("crop"), "page_w", "page_h", F.lit(None).cast("double").alias("target_w"), F.lit(None).cast("double").alias("target_h")
    )
    number = F.when(F.col("page") % 4 != 0, F.col("page_index") + 1 + F.when(F.col("page_index") > 20, 5).otherwise(0)).cast("int")
    return m.join(r, "page").select(
        F.col("doc").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.struct(F.lit("x").alias("path"), F.col("page_index").cast("int").alias("page_index"), F.lit(None).cast("string").alias("embedded_image_id"), F.lit(1.0).alias("ocr_scale")).alias("source"),
        "dpi", F.struct(((F.col("page") % 21 - 10) / 10).alias("angle_deg"), ((F.col("page") % 30) / 10).alias("confidence")).alias("deskew"), margin.alias("margin"), plain.alias("regions"),
        F.lit("auto").alias("page_kind"), F.when(F.col("page") % 13 == 0, F.array(F.lit("page_number_gap"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(F.col("page") % 13 == 0, "needs_review").otherwise("auto").alias("review_status"), F.lit("auto").alias("decided_by"), F.lit(None).cast("string").alias("nombre_text"),
        number.alias("page_number"), F.lit(False).alias("blank"), F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"), "page",
    )


SQL = """b_cand AS (SELECT book_id AS doc, page_index AS i, 0::BIGINT AS ord, CASE WHEN page_index % 11 = 3 THEN 'top' ELSE 'bottom' END AS band, kind, v, CAST(v AS VARCHAR) AS text,
    CAST(CASE WHEN page_index % 5 = 4 THEN 500 WHEN page_index % 2 = 0 THEN 850 ELSE 120 END + (book_id * 7 + page_index) % 13 AS DOUBLE) AS x0, CAST(950 + (book_id + page_index * 3) % 7 AS DOUBLE) AS y0 FROM b_folio
    UNION ALL SELECT book_id, page_index, 1, 'top', 'num', 11, '11', 500.0, 50.0 FROM b_folio WHERE page_index % 3 <> 0),
b_hull AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b_region GROUP BY page),
b_margin0 AS (SELECT page % 40 AS doc, row_number() OVER (PARTITION BY page % 40 ORDER BY page) - 1 AS page_index, * FROM b_hull),
b_margin AS (SELECT *, CASE WHEN doc % 4 <> 0 THEN CAST(300 + 100 * (doc % 3) AS DOUBLE) END AS dpi, (page % 10) / 10 AS confidence, CASE WHEN page % 9 <> 0 THEN 1200.0::DOUBLE END AS page_w, CASE WHEN page % 9 <> 0 THEN 10000.0::DOUBLE END AS page_h,
    CASE WHEN page % 3 <> 0 THEN CASE WHEN page_index % 2 = 0 THEN 40.0 ELSE 1100.0 END + page % 7 END::DOUBLE AS nx0, CASE WHEN page % 3 <> 0 THEN 9700.0 + page % 5 END::DOUBLE AS ny0 FROM b_margin0),
b_text AS (SELECT m.doc, m.page_index, r.page, r.rid, CASE WHEN r.kind = 'R' THEN 'photo' ELSE 'text' END AS kind, r.x0, r.y0, r.x1, r.y1 FROM b_region r JOIN b_margin m USING (page)),
b_flat AS (SELECT CAST(doc AS VARCHAR) AS doc_id, page_index, page, 1200.0::DOUBLE AS pw, 10000.0::DOUBLE AS ph, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1, nx0, ny0, confidence, (page % 21 - 10) / 10 AS angle, (page % 30) / 10 AS dconf,
    CASE WHEN page % 4 <> 0 THEN page_index + 1 + CASE WHEN page_index > 20 THEN 5 ELSE 0 END END AS number, page % 13 = 0 AS flagged FROM b_margin),
b_piece AS (SELECT f.doc_id, f.page_index, f.page, CASE WHEN l_returnflag = 'R' THEN 'photo' ELSE 'text' END AS cls, l_linestatus AS source, l_discount AS conf, CAST(l_partkey AS VARCHAR) AS ocr_text, CAST(l_partkey % 800 AS DOUBLE) AS x0, CAST(l_suppkey * 9 AS DOUBLE) AS y0,
    CAST(l_partkey % 800 AS DOUBLE) + 4 * l_quantity AS x1, CAST(l_suppkey * 9 AS DOUBLE) + l_quantity AS y1,
    row_number() OVER (PARTITION BY f.page ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN 'photo' ELSE 'text' END) - 1 AS pos FROM lineitem JOIN b_flat f ON f.page = l_orderkey)"""
