"""Registered queries of records: labels and results of engines, stored pages, the training log, edits, boxes and text fitting.

Each reads whole tables and has SQL that works out the same rows another way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions import drawing, engines
from leafmill.operators import learn, review, runs, spatial, store
from leafmill.plans import page_bindings as pb
from leafmill.plans.bindings import SQL, b_region, read
from leafmill.sources.files import scratch

QUERIES, ORACLE_SQL = {}, {}
SIDES = ("x0", "y0", "x1", "y1")


def registered(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {SQL}, {pb.SQL} {sql}"
        return f

    return keep


# Engines ----------------------------------------------------------------------------------------


def _values(table: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


_RAW = [*engines.DOCUMENT_LABELS, "other thing"]
_BLOCK = [*engines.BLOCK_LABELS, "block_new"]


def _picked(names: list[str], place):
    return F.element_at(F.array(*map(F.lit, names)), (place % len(names) + 1).cast("int"))


@registered(f""", d(k, v) AS (VALUES {_values(engines.DOCUMENT_LABELS)}), c(k, v) AS (VALUES {_values(engines.CLASS_LABELS)}), b(k, v) AS (VALUES {_values(engines.BLOCK_LABELS)}),
r AS (SELECT upper({_RAW}[l_partkey % {len(_RAW)} + 1]) AS raw, CAST(l_partkey % 20 AS INTEGER) AS class_id, {_BLOCK}[l_partkey % {len(_BLOCK)} + 1] AS block FROM lineitem)
SELECT raw, class_id, block, count(*) AS n, coalesce(any_value(d.v), lower(raw)) AS document_label, any_value(c.v) AS class_label, coalesce(any_value(b.v), 'figure') AS block_label
FROM r LEFT JOIN d ON d.k = lower(raw) LEFT JOIN c ON CAST(c.k AS INTEGER) = class_id LEFT JOIN b ON b.k = block GROUP BY raw, class_id, block""")
def engine_labels(spark, d):
    """Labels of all three layout vocabularies, known and unknown."""
    p = F.col("l_partkey")
    r = read(spark, d, "lineitem").select(F.upper(_picked(_RAW, p)).alias("raw"), (p % 20).cast("int").alias("class_id"), _picked(_BLOCK, p).alias("block"))
    n = r.groupBy("raw", "class_id", "block").agg(F.count("*").alias("n"))
    return n.withColumns({"document_label": engines.document_label(F.col("raw")), "class_label": engines.class_label(F.col("class_id")), "block_label": engines.block_label(F.col("block"))})


@registered(""", p AS (SELECT page, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM b_region) GROUP BY page),
o AS (SELECT page, rid, x0, y0, x1, y1, kind, row_number() OVER (PARTITION BY page ORDER BY rid, x0, x1, kind) - 1 AS pos FROM b_region)
SELECT page, 'line' AS part, pos, CASE WHEN kind <> 'R' THEN CAST(rid AS VARCHAR) END AS label, x0, y0, x1, y1 FROM o
UNION ALL SELECT page, 'layout', pos, CASE kind WHEN 'N' THEN 'page_number' WHEN 'A' THEN 'table' ELSE 'note' END, x0, y0, x1, y1 FROM o WHERE page % 3 <> 0""")
def engine_results(spark, d):
    """Lines with a box or a polygon and layout boxes of results as JSON; the layout of every third page failed."""
    r = b_region(spark, d)
    one = r.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("rid", "x0", "x1", "kind", "y0", "y1"))).alias("r"))
    box = lambda x: F.array(x["x0"], x["y0"], x["x1"], x["y1"])
    polygon = lambda x: F.array(F.array(x["x1"], x["y0"]), F.array(x["x0"], x["y0"]), F.array(x["x0"], x["y1"]), F.array(x["x1"], x["y1"]))
    raw = lambda x: F.when(x["kind"] == "N", "NUMBER").when(x["kind"] == "A", "Table").otherwise("footnote")
    texts = F.transform("r", lambda x: F.when(x["kind"] != "R", x["rid"].cast("string")).otherwise(""))
    found = F.struct(F.transform("r", lambda x: F.struct(raw(x).alias("label"), box(x).alias("coordinate"), F.lit(0.5).alias("score"))).alias("boxes"))
    placed = F.when(F.col("page") % 2 == 0, F.struct(F.transform("r", box).alias("rec_boxes"), texts.alias("rec_texts"), found.alias("layout_det_res")))
    json = F.coalesce(F.to_json(placed), F.to_json(F.struct(F.transform("r", polygon).alias("rec_polys"), texts.alias("rec_texts"), found.alias("layout_det_res"))))
    res = one.select("page", F.from_json(json, engines.RESULT_SCHEMA).alias("res"))
    both = res.select("page", engines.composite(engines.recognised_lines(F.col("res"), "e"), F.when(F.col("page") % 3 != 0, engines.layout_boxes(F.col("res"), "e"))).alias("c"))
    rows = lambda part, label: both.select("page", F.lit(part).alias("part"), F.posexplode(f"c.{'lines' if part == 'line' else part}").alias("pos", "x")).select("page", "part", F.col("pos").cast("long").alias("pos"), F.col(f"x.{label}").alias("label"), "x.box.*")
    return rows("line", "text").unionByName(rows("layout", "label"))


# Stored pages -----------------------------------------------------------------------------------


@registered(" SELECT f.doc_id, f.page_index, confidence, angle, number, flagged, count(b.pos) AS regions, sum(b.x1 - b.x0) AS widths, max(b.ocr_text) AS last_text, CASE WHEN flagged THEN 'needs_review' ELSE 'auto' END AS review_status FROM b_flat f JOIN b_piece b USING (page) GROUP BY ALL")
def stored_pages(spark, d):
    """Whole nested pages as JSON rows of a store, read back."""
    s = store.Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    pages = pb.b_nested(spark, d)
    s.merge("pages", store.encoded(pages.drop("page_w", "page_h", "page")).withColumn("updated_at", F.lit(1.0)), "updated_at")
    # Rows have no order here, so the store's ordered reading, a shuffle of all JSON, is left out.
    back = store.decoded(s.read("pages"))
    return back.select(
        "doc_id", F.col("page_index").cast("long").alias("page_index"), F.col("margin.confidence").alias("confidence"), F.col("deskew.angle_deg").alias("angle"), F.col("page_number").cast("long").alias("number"),
        F.array_contains("flags", "page_number_gap").alias("flagged"), F.size("regions").cast("long").alias("regions"),
        F.aggregate("regions", F.lit(0.0), lambda t, r: t + r["box"]["x1"] - r["box"]["x0"]).alias("widths"), F.array_max("regions.ocr_text").alias("last_text"), "review_status",
    )


@registered(" SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN user_id % 4 = 0 THEN 'bw' ELSE 'color' END AS label, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS DOUBLE) AS k FROM events WHERE event_type = 'click' AND user_id % 4 <> 3 AND event_id % 5 <> 0")
def training_log(spark, d):
    """Decisions appended to a store's log in two commits; of those on page kinds the readable ones, as examples. Broken JSON and unknown labels are skipped."""
    s = store.Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    u = F.col("user_id") % 4
    e = read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.lit("human").alias("decided_by"),
        F.when(F.col("event_type") == "click", "page_kind").otherwise(F.col("event_type")).alias("field"), F.lit(None).cast("string").alias("old_value"),
        F.when(u == 0, '"bw"').when(u == 3, '"odd"').otherwise("color").alias("new_value"),
        F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"id": '), "event_id", F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}"))).alias("features"),
        F.col("event_id").cast("double").alias("created_at"),
    )
    for part in (e.where("created_at % 2 = 0"), e.where("created_at % 2 = 1")):
        s.append("decisions", part)
    rows = learn.training_rows(s.training_log("page_kind"))
    return rows.select(F.element_at("features", F.lit("id")).cast("long").alias("id"), "label", F.element_at("features", F.lit("k")).alias("k"))


# Edits ------------------------------------------------------------------------------------------


@registered(""", e AS (SELECT page, count(*) FILTER (kind = 'R') AS added, max_by(x0, rid) FILTER (kind = 'A') AS cx0, max_by(x1, rid) FILTER (kind = 'A') AS cx1, count(*) FILTER (kind = 'N') > 0 AS cleared FROM b_region GROUP BY page)
SELECT m.doc, m.page_index, coalesce(e.cx0, m.x0) AS cx0, coalesce(e.cx1, m.x1) AS cx1, CASE WHEN e.cx0 IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, CASE WHEN NOT cleared THEN nx0 END AS nx0, CASE WHEN added > 0 THEN added ELSE 1 END AS regions FROM b_margin m JOIN e USING (page)""")
def edited_pages(spark, d):
    """Pages after edits made of their regions: A sets the content box, N takes the number box, R adds a photo; the first region is deleted if one was added."""
    m = pb.b_margin(spark, d)
    at = m.select(F.col("page"), F.col("doc").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"))
    r = b_region(spark, d).join(at, "page")
    box = F.struct(*SIDES)
    boxes = r.where("kind IN ('A', 'N')").select("doc_id", "page_index", F.col("rid").alias("seq"), F.when(F.col("kind") == "A", "content").otherwise("nombre").alias("field"), F.when(F.col("kind") == "A", box).alias("box"))
    pages = m.withColumns({"doc_id": F.col("doc").cast("string"), "page_index": F.col("page_index").cast("int")})
    first = F.array(F.struct(F.lit("text").alias("kind"), F.col("content").alias("box"), F.lit("x").alias("source"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast("double").alias("ocr_conf"), F.lit(None).cast("string").alias("tone"), F.lit(None).cast("string").alias("layout_label")))
    pages = review.box_edits(pages.withColumn("regions", first), boxes)
    added = r.where("kind = 'R'").select("doc_id", "page_index", F.col("rid").alias("seq"), F.lit("photo").alias("kind"), box.alias("box"), F.lit("gray").alias("tone"), F.lit(None).cast("int").alias("index"))
    gone = added.groupBy("doc_id", "page_index").agg((F.min("seq") - 1).alias("seq")).select("doc_id", "page_index", "seq", F.lit(None).cast("string").alias("kind"), F.lit(None).cast(added.schema["box"].dataType).alias("box"), F.lit(None).cast("string").alias("tone"), F.lit(0).alias("index"))
    out = review.region_edits(pages, added.unionByName(gone))
    return out.select("doc", F.col("page_index").cast("long").alias("page_index"), F.col("content.x0").alias("cx0"), F.col("content.x1").alias("cx1"), "confidence", F.col("nombre.x0").alias("nx0"), F.size("regions").cast("long").alias("regions"))


# Boxes and texts --------------------------------------------------------------------------------


@registered(""", p AS (SELECT *, greatest(3, CAST(floor(0.01 * greatest(x1 - x0, y1 - y0)) AS BIGINT)) AS pad FROM b_region)
SELECT page, rid, kind, greatest(0, least(900, x0 - pad)) AS x0, greatest(0, least(500, y0 - pad)) AS y0, greatest(0, least(900, x1 + pad)) AS x1, greatest(0, least(500, y1 + pad)) AS y1 FROM p""")
def padded_boxes(spark, d):
    """Boxes padded, then held on a page of 900 by 500."""
    b = spatial.clamped(spatial.padded(F.struct(*SIDES)), F.lit(900), F.lit(500))
    return b_region(spark, d).withColumn("b", b).select("page", "rid", "kind", "b.*")


@registered(""", t AS (SELECT DISTINCT l_partkey AS p, l_quantity AS q FROM lineitem), r AS (SELECT *, unnest(range(1, 51)) AS i FROM t)
SELECT p, q, arg_min(i / 50.0, abs((0.2 + p % 9) * (8 + q) * (i / 50.0) - 3 * q) * 1e6 + i * 1e-6) AS rate, printf('#%02x%02x%02x', CAST(p % 256 AS INTEGER), CAST(q AS INTEGER), CAST(p % 7 AS INTEGER)) AS colour FROM r GROUP BY p, q""")
def fitted_texts(spark, d):
    """The size at which a text fits its box, and a colour as hex."""
    t = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q")).distinct()
    rate = drawing.font_fit(0.2 + F.col("p") % 9, 3.0 * F.col("q"), (8 + F.col("q")).cast("double"))
    return t.select("p", "q", rate.alias("rate"), drawing.hex_colour(F.col("p") % 7, F.col("q"), F.col("p") % 256).alias("colour"))


def _norm() -> str:
    from leafmill.plans.page_catalogue import _NORM

    return _NORM


@registered(f"{_norm()} SELECT m.doc, m.page_index, round(kx, 3) AS x0, round(kx + cw, 3) AS x1, round(tw, 3) AS target_w, coalesce(cw > 1.001 * tw OR ch > 1.001 * th, false) AS scaled_down FROM b_margin m LEFT JOIN c5 USING (doc, page_index)")
def remargined(spark, d):
    """Crops of stored boxes worked out anew, with the flag of pages that do not fit their book's size."""
    m = pb.b_margin(spark, d)
    out = runs.renormalised(m.withColumn("flags", F.array(F.lit(runs.SCALED), F.lit("other"))), pb.b_text(spark, d, m))
    return out.select("doc", "page_index", F.round("crop.x0", 3).alias("x0"), F.round("crop.x1", 3).alias("x1"), F.round("target_w", 3).alias("target_w"), F.array_contains("flags", runs.SCALED).alias("scaled_down"))
