"""Features, margins, learner, relations, storage, review, drawing, engines, pixels, sources, streams."""

import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.functions import drawing, engines, pixels, registry
from leafmill.operators import features, learn, margins, rasters, review, runs, sequence, spatial, store
from leafmill.sources import page_images
from leafmill.streaming import decisions

PF = "doc_id string, page_index int, nombre_value int"


def test_body_run(spark):
    rows = [("a", i, None) for i in range(5)] + [("a", 5 + i, 6 + i) for i in range(10)] + [("a", 15 + i, 35 + i) for i in range(4)]
    rows += [("b", i, None if 3 <= i < 6 else i + 1) for i in range(11)] + [("c", 0, None)]
    d = spark.createDataFrame(rows, PF)
    got = {r["doc_id"]: (r["front_end"], r["body_end"]) for r in features.body_run(d, features.dominant_offset(d)).collect()}
    assert got == {"a": (5, 14), "b": (0, 10), "c": (None, None)}


def test_direction_and_binding(spark):
    tall = [("v", 0, "text", 0.1 * k, 0.0, 0.1 * k + 0.02, 0.5) for k in range(6)]
    wide = [("h", 0, "text", 0.1, 0.1 * k, 0.9, 0.1 * k + 0.02) for k in range(6)]
    r = spark.createDataFrame([*tall, *wide, ("u", 0, "photo", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page_index int, cls string, x0 double, y0 double, x1 double, y1 double")
    ways = features.writing_direction(r)
    assert {x["doc_id"]: x["writing_dir"] for x in ways.collect()} == {"v": "vertical", "h": "horizontal", "u": "unknown"}
    f = spark.createDataFrame([("r", i, 0.08 if i % 2 == 0 else 0.9) for i in range(8)] + [("v", 0, None), ("h", 0, 0.5)], "doc_id string, page_index int, nombre_cx double")
    assert {x["doc_id"]: x["binding"] for x in features.binding_side(f, ways).collect()} == {"r": "right", "v": "right", "h": "left"}


def test_predicates(spark):
    d = spark.createDataFrame([(True, 0, 0.0001, ["no_text_detected"]), (True, 0, 0.1, ["no_text_detected"]), (False, 0, 0.0, [])], "is_ocr boolean, region_count int, ink double, flags array<string>")
    assert [(r["blank"], r["flags"]) for r in features.blank_pages(d).collect()] == [(True, []), (False, ["no_text_detected"]), (False, [])]
    e = spark.range(1).select(features.page_mode(F.lit(False), F.lit(True), F.lit(True)).alias("m"), features.render_mode(F.lit("mrc")).alias("r"), features.low_coverage(F.lit(1), F.lit(10)).alias("l"), features.low_coverage(F.lit(1), F.lit(0)).alias("z"), features.text_direction(*map(F.lit, (0, 0, 1, 2))).alias("t")).first()
    assert tuple(e) == ("color", "bw", True, False, "v")
    box = F.struct(*(F.lit(float(v)).alias(n) for v, n in ((0, "x0"), (0, "y0"), (10, "x1"), (10, "y1"))))
    c = spark.range(1).select(features.content_or_page(box, F.lit(0), F.lit(100.0), F.lit(100.0), F.lit(0.9)).alias("c")).first()["c"]
    assert c["confidence"] == 0 and c["content"]["x1"] == 100


def page(doc, i, content, nombre=None, dpi=600.0, conf=0.8, w=None, h=None):
    return (doc, i, dpi, conf, w, h, content, nombre, content)


MARGIN = "doc string, page_index int, dpi double, confidence double, page_w double, page_h double, content struct<x0:double,y0:double,x1:double,y1:double>, nombre struct<x0:double,y0:double,x1:double,y1:double>, body struct<x0:double,y0:double,x1:double,y1:double>"


def test_crops_are_even_and_hold_content(spark):
    rows = [page("a", i, (100.0 + i, 100.0, 480.0 + i, 680.0)) for i in range(6)] + [page("a", 6, (10.0, 10.0, 650.0, 1030.0))]
    rows += [page("b", i, (100.0, 120.0, 480.0 - 9 * i, 680.0), (460.0, 700.0, 480.0, 712.0) if i % 2 else (100.0, 700.0, 120.0, 712.0), w=600.0, h=900.0) for i in range(8)]
    got = margins.normalise(spark.createDataFrame(rows, MARGIN)).collect()
    one = [r for r in got if r["doc"] == "a"]
    assert len({(round(r["target_w"], 6), round(r["target_h"], 6)) for r in got if r["doc"] == "a"}) == 1
    for r, p in zip(sorted(one, key=lambda r: r["page_index"]), rows, strict=False):
        assert r["crop"]["x0"] <= p[6][0] and r["crop"]["x1"] >= p[6][2] and r["crop"]["y0"] <= p[6][1] and r["crop"]["y1"] >= p[6][3]
    two = {r["page_index"]: r["crop"] for r in got if r["doc"] == "b"}
    assert len({round(two[i]["x0"], 6) for i in (0, 2)}) == 1  # the number's edge lands at one place
    assert all(two[i]["x0"] <= rows[7 + i][6][0] and two[i]["x1"] >= rows[7 + i][6][2] for i in two)


def test_margin_outliers(spark):
    rows = [page("a", i, (0.0, 0.0, 100.0, 100.0)) for i in range(5)] + [page("a", 5, (0.0, 0.0, 140.0, 100.0)), page("a", 6, (0.0, 0.0, 90.0, 90.0), conf=0.1)]
    got = {r["page_index"]: r["margin_flag"] for r in margins.align_margins(spark.createDataFrame(rows, MARGIN)).collect()}
    assert got[0] is None and got[5] == "margin_inconsistent_with_neighbors" and got[6] == "margin_not_found"


def test_body_box_leaves_out_side_heads(spark):
    p = spark.createDataFrame([page("a", 0, (0.0, 0.0, 1000.0, 1000.0)), page("a", 1, (0.0, 0.0, 1000.0, 1000.0))], MARGIN).drop("body")
    r = spark.createDataFrame([("a", 0, "text", 100.0, 50.0, 800.0, 90.0), ("a", 0, "text", 110.0, 100.0, 790.0, 900.0), ("a", 0, "text", 950.0, 10.0, 990.0, 990.0), ("a", 1, "text", 10.0, 0.0, 60.0, 900.0), ("a", 1, "text", 200.0, 0.0, 260.0, 900.0)], "doc string, page_index int, kind string, x0 double, y0 double, x1 double, y1 double")
    got = {x["page_index"]: tuple(x["body"]) for x in margins.body_boxes(p, r).collect()}
    assert got == {0: (100.0, 50.0, 800.0, 900.0), 1: (0.0, 0.0, 1000.0, 1000.0)}


def test_transform(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))
    none = F.lit(None).cast("double")
    r = spark.range(1).select(
        margins.transform(F.lit(400.0), F.lit(600.0), F.lit(0.0), box(50, 100, 250, 500), none, none, F.lit(600.0), 600).alias("a"),
        margins.transform(F.lit(200.0), F.lit(200.0), F.lit(0.0), box(0, 0, 100, 100), none, none, F.lit(300.0), 600).alias("b"),
        margins.transform(F.lit(200.0), F.lit(200.0), F.lit(-0.4), box(0, 0, 100, 100), none, none, F.lit(300.0), 300).alias("c"),
    ).first()
    assert (r["a"]["scale"], r["a"]["out_w"], r["a"]["out_h"]) == (1.0, 200, 400) and (r["b"]["scale"], r["b"]["out_w"]) == (2.0, 200)
    m = r["c"]["m"]
    hull = spark.range(1).select(margins.mapped(box(0, 0, 50, 10), F.array(*map(F.lit, m))).alias("h")).first()["h"]
    for x in (0, 50):
        for y in (0, 10):
            px, py = m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
            assert hull["x0"] - 1e-9 <= px <= hull["x1"] + 1e-9 and hull["y0"] - 1e-9 <= py <= hull["y1"] + 1e-9


def test_learner(spark):
    rows = [json.dumps({"n_text": 30.0, "n_photo": 0.0})] * 4, [json.dumps({"n_text": 0.0, "n_photo": 3.0})] * 4
    d = spark.createDataFrame([(f, '"bw"', "page_kind") for f in rows[0]] + [(f, '"color"', "page_kind") for f in rows[1]] + [("{broken", '"bw"', "page_kind"), (rows[0][0], '"zzz"', "page_kind")], "features string, new_value string, field string")
    t = learn.training_rows(d)
    assert t.count() == 8
    v = t.withColumn("v", features.vector("features", ("n_text", "n_photo", "absent")))
    model = learn.centroids(v, "label", "v")
    assert model.count() == 2
    out = learn.classify(v, model, "label", "v").collect()
    assert all(r["predicted"] == r["label"] and r["confidence"] == pytest.approx(1.0) for r in out)
    assert learn.centroids(v.where("label = 'bw'"), "label", "v").count() == 0
    lost = learn.classify(v, learn.centroids(v.where("label = 'bw'"), "label", "v"), "label", "v").first()
    assert lost["predicted"] is None and lost["confidence"] is None


def test_spatial_relations_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(3)), k, "ab"[k % 2], *(float(v) for v in (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(rng.integers(0, 300, (120, 4)))]
    d = spark.createDataFrame(rows, "page int, pos int, label string, x0 double, y0 double, x1 double, y1 double")
    a, b = d.where("label = 'a'"), d.where("label = 'b'")
    met = {(r["a"]["pos"], r["b"]["pos"]) for r in spatial.meeting(a, b, ["page"], cell=50.0).collect()}
    want = {(p[1], q[1]) for p in rows for q in rows if p[2] == "a" and q[2] == "b" and p[0] == q[0] and p[3] <= q[5] and q[3] <= p[5] and p[4] <= q[6] and q[4] <= p[6]}
    assert met == want and spatial.meeting(a, b, ["page"], cell=50.0).count() == len(want)
    kept = {r["pos"] for r in spatial.distinct_boxes(d, ["page"]).collect()}
    held = []
    for p in sorted(rows, key=lambda r: (r[0], r[4], r[3], (r[5] - r[3]) * (r[6] - r[4]), r[1])):
        def over(q, p=p):
            inner = max(0, min(p[5], q[5]) - max(p[3], q[3])) * max(0, min(p[6], q[6]) - max(p[4], q[4]))
            return inner > 0 and inner / max((p[5] - p[3]) * (p[6] - p[4]) + (q[5] - q[3]) * (q[6] - q[4]) - inner, 1) > 0.55
        if not any(q[0] == p[0] and over(q) for q in held):
            held.append(p)
    assert kept == {p[1] for p in held}


def test_position_clusters(spark):
    rows = [(1, i, 0, "bottom", "num", i + 1, 0.9 if i % 2 else 0.1, 0.95) for i in range(6)] + [(1, i, 1, "bottom", "num", (i * 7) % 50, 0.3 + 0.05 * i, 0.9) for i in range(6)]
    d = spark.createDataFrame(rows, "doc long, i long, ord long, band string, kind string, v long, fx double, fy double")
    assert {(r["i"], r["ord"]) for r in spatial.position_clusters(d).collect()} == {(i, 0) for i in range(6)}


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/a")
    cols = store.TABLES["pages"].schema
    s.upsert("pages", spark.createDataFrame([("d", 0, "{}", "auto", [], 1.0), ("d", 1, "{}", "needs_review", ["x"], 1.0)], cols), [F.desc("updated_at")])
    s.upsert("pages", spark.createDataFrame([("d", 0, '{"n":1}', "approved", [], 2.0), ("d", 0, '{"n":2}', "auto", [], 1.5)], cols), [F.desc("updated_at")])
    assert [(r["page_index"], r["review_status"]) for r in s.pages("d").collect()] == [(0, "approved"), (1, "needs_review")]
    assert s.page("d", 0).first()["params_json"] == '{"n":1}' and [r[0] for r in s.documents().collect()] == ["d"]
    feature = store.TABLES["page_feature"].schema
    s.replace("page_feature", spark.createDataFrame([("d", i, True, 1, 0.0, 0.0, 0.1, 0.1, None, None, None, False) for i in range(3)], feature))
    s.replace("page_feature", spark.createDataFrame([("d", 9, True, 1, 0.0, 0.0, 0.1, 0.1, None, None, None, False)], feature))
    assert [r["page_index"] for r in s.features("d").collect()] == [9]
    s.append("decisions", spark.createDataFrame([("d", 0, "human", "page_kind", None, '"bw"', "{}", 1.0)], "doc_id string, page_index int, decided_by string, field string, old_value string, new_value string, features string, created_at double"))
    other = store.Store(spark, f"file://{tmp_path}/b")
    other.upsert("pages", spark.createDataFrame([("e", 0, "{}", "auto", [], 1.0)], cols), [F.desc("updated_at")])
    s.fold([other])
    assert s.pages().count() == 3 and s.training_log("page_kind").columns == ["features", "new_value"] and s.training_log().count() == 1
    assert store.Store(spark, f"file://{tmp_path}/none").pages().count() == 0


def test_pages_as_rows(spark):
    region = ("text", (1.0, 2.0, 3.0, 4.0), "dbnet", "序章", 0.9, None, None)
    row = ("d", 2, ("p", 2, None, 0.5), 600.0, (1.25, 3.1), ((10.0, 20.0, 110.0, 220.0), 0.9, (50.0, 5.0, 70.0, 18.0), None, None, None, None, None), [region], "auto", ["deskew_low_confidence"], "needs_review", "auto", None, None, False)
    d = spark.createDataFrame([row], features.PAGE_SCHEMA)
    back = store.decoded(store.encoded(d)).select(*d.columns)
    assert back.collect() == d.collect() and back.select(features.reading_text(F.col("regions"))).first()[0] == "序章"
    good, bad = store.quarantined(d.withColumn("page_kind", F.lit("odd")), "page_kind", features.PAGE_KINDS)
    assert good.count() == 0 and bad.count() == 1


def test_review_folds(spark):
    region = ("text", (0.0, 0.0, 1.0, 1.0), "dbnet", None, None, None, None)
    p = spark.createDataFrame([("d", 0, [region]), ("d", 1, None)], f"doc_id string, page_index int, regions array<{features.REGION_SCHEMA}>")
    e = spark.createDataFrame([("d", 0, 1, "photo", (1.0, 1.0, 2.0, 2.0), "gray", None), ("d", 0, 2, "text", (3.0, 1.0, 4.0, 2.0), "gray", None), ("d", 0, 3, None, None, None, 0), ("d", 0, 4, None, None, None, 99)], f"doc_id string, page_index int, seq int, kind string, box {features.BOX_SCHEMA}, tone string, index int")
    got = {r["page_index"]: r["regions"] for r in review.region_edits(p, e).collect()}
    assert [(r["kind"], r["source"], r["tone"]) for r in got[0]] == [("photo", "manual", "gray"), ("text", "manual", None)] and got[1] is None
    boxes = spark.createDataFrame([("d", 0, (0.0, 0.0, 9.0, 9.0), 0.3, (1.0, 1.0, 2.0, 2.0))], f"doc_id string, page_index int, content {features.BOX_SCHEMA}, confidence double, nombre {features.BOX_SCHEMA}")
    edits = spark.createDataFrame([("d", 0, 1, "content", (1.0, 1.0, 5.0, 5.0)), ("d", 0, 2, "nombre", None)], f"doc_id string, page_index int, seq int, field string, box {features.BOX_SCHEMA}")
    r = review.box_edits(boxes, edits).first()
    assert r["confidence"] == 1.0 and r["content"]["x1"] == 5.0 and r["nombre"] is None and review.books_to_renormalise(edits).count() == 1


def test_page_selection(spark):
    assert sequence.page_numbers(None) is None and sequence.page_numbers("") is None
    assert sequence.page_numbers("9") == [(9, 9)] and sequence.page_numbers("52,236-237") == [(52, 52), (236, 237)]
    assert [r[0] for r in sequence.selected_pages(spark.range(10), "id", "0-2, 7").orderBy("id").collect()] == [0, 1, 2, 7]


def test_drawing(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(drawing.fill_rect(*lit(10, 20, 30, 60, 0.5, 100, 0.5)).alias("f"), drawing.hex_colour(F.lit(0), F.lit(200), F.lit(255)).alias("h"), drawing.circle_path(*lit(10, 10, 5, 20)).alias("c"), drawing.font_fit(*lit(2.0, 30, 20)).alias("s")).first()
    assert r["f"] == "0.50 g 5.00 70.00 10.00 20.00 re f\n" and r["h"] == "#ffc800" and r["s"] == pytest.approx(0.75, abs=0.011)
    assert r["c"].startswith("15.00 10.00 m 15.00 12.76 12.76 15.00 10.00 15.00 c") and r["c"].endswith(" c h\n")


def test_engines(spark):
    name = lambda a, b, c: engines.engine_parts(F.lit(a), F.lit(b), F.lit(c))
    r = spark.range(1).select(name(None, None, None).alias("a"), name("PaddleOCR_v6", None, None).alias("b"), name("Own_Engine", None, "off").alias("c"), name("pp-structure", None, None).alias("d")).first()
    assert [tuple(x) for x in r] == [("hybrid", "hybrid"), ("none", "ppocr-v6"), ("own-engine", "none"), ("pp-structurev3", "none")]
    payload = json.dumps({"rec_polys": [[[0, 0], [4, 0], [4, 2], [0, 2]]], "rec_texts": ["a", "b"], "rec_scores": [0.9], "layout_det_res": {"boxes": [{"label": "Image", "coordinate": [0, 0, 5, 5], "score": 0.5}, {"label": "x", "coordinate": [1]}]}, "parsing_res_list": [{"block_bbox": [1, 1, 2, 2], "block_label": "number"}]})
    d = spark.createDataFrame([(payload,)], "j string").select(F.from_json("j", engines.RESULT_SCHEMA).alias("r"))
    x = d.select(engines.recognised_lines(F.col("r"), "s").alias("l"), engines.layout_boxes(F.col("r"), "s").alias("b")).first()
    assert [(l["text"], tuple(l["box"]), l["det_score"]) for l in x["l"]] == [("a", (0.0, 0.0, 4.0, 2.0), 0.9)]
    assert [(b["label"], b["raw_label"]) for b in x["b"]] == [("figure", "image"), ("page_number", "number")]


def bars(turn=0.0):
    img = np.full((600, 800), 255, np.uint8)
    for y in range(60, 540, 44):
        img[y : y + 16, 100:700] = 0
    return pixels.rotated(img, turn, 255) if turn else img


def test_pixel_kernels():
    angle, sure = pixels.skew(bars(2.0))
    assert abs(abs(angle) - 2.0) <= 0.5 and sure > 1.5 and abs(pixels.skew(bars())[0]) < 0.2
    assert pixels.skew(np.full((300, 400), 255, np.uint8)) == (0.0, 0.0)
    mask = np.random.default_rng(1).random((40, 50)) < 0.4
    labels, boxes = pixels.components(mask)
    seen, groups = np.zeros_like(mask), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            groups, stack, one = groups + 1, [(y, x)], labels[y, x]
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                assert labels[a, b] == one
                for p in range(max(0, a - 1), min(40, a + 2)):
                    for q in range(max(0, b - 1), min(50, b + 2)):
                        if mask[p, q] and not seen[p, q]:
                            seen[p, q] = True
                            stack.append((p, q))
    assert groups == len(boxes) and boxes[:, 4].sum() == mask.sum()
    shadow = bars()
    shadow[:, 8:11] = 0
    words = bars()
    words[:, 350:370] = 255  # no line of words is one long part
    assert (pixels.without_edge_shadows(shadow)[:, 8:11] == 255).all() and (pixels.without_edge_shadows(words) == words).all()
    box, sure, _ = pixels.content_box(words)
    assert box == (100.0, 60.0, 700.0, 516.0) and sure > 0
    assert (pixels.without_strokes(shadow, (100, 60, 700, 516))[:, 8:11] == 255).all()
    assert (pixels.without_strokes(shadow, (100, 60, 700, 516), [(0, 0, 20, 600)])[:, 8:11] == 0).all()
    speck = bars()
    speck[5, 5] = 0
    assert pixels.despeckled(pixels.binarised(speck))[5, 5] == 255
    panel = np.full((300, 300), 250, np.uint8)
    panel[100:180, 40:260] = 160
    assert pixels.tint_panels(panel)[0][:4] == (40, 100, 260, 180)
    centres, near = pixels.posterised(np.repeat(np.array([10, 80, 160, 240], np.uint8), 50).reshape(10, 20))
    assert centres.tolist() == [10, 80, 160, 240] and near.max() == 3


def png_bytes(img):
    h, w = img.shape
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    rows, above = b"", np.zeros(w, np.uint8)
    for y in range(h):
        kind = y % 3
        line = img[y] - (np.r_[np.uint8(0), img[y][:-1]] if kind == 1 else above if kind == 2 else 0)
        rows, above = rows + bytes([kind]) + line.astype(np.uint8).tobytes(), img[y]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\0\0\0\0") + chunk(b"pHYs", (11811).to_bytes(4, "big") * 2 + b"\x01") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_page_source_and_rasters(spark, tmp_path):
    small = bars()[::4, ::4]
    small[:, 87:93] = 255
    (tmp_path / "a.png").write_bytes(png_bytes(small))
    one = b"P5\n200 150\n255\n" + small.tobytes()
    (tmp_path / "b.pgm").write_bytes(one * 3)
    spark.dataSource.register(page_images.PageSource)
    p = spark.read.format("leaf_pages").option("path", str(tmp_path)).option("pages", "0,2").load()
    rows = sorted((r["doc"].rsplit("/", 1)[1], r["page_index"], r["dpi"]) for r in p.collect())
    assert rows == [("a.png", 0, pytest.approx(300, abs=0.1)), ("b.pgm", 0, None), ("b.pgm", 2, None)]
    assert all(np.frombuffer(r["pixels"], np.uint8).reshape(150, 200).tolist() == small.tolist() for r in p.collect())
    again = page_images.decoded(spark.read.format("binaryFile").load(str(tmp_path)), "1")
    assert [(r["page_index"], r["height"]) for r in again.collect()] == [(1, 150)]
    assert {r["confidence"] is not None for r in rasters.deskewed(p).collect()} == {True} and rasters.components(p).count() == 3 * 22
    c = rasters.contents(p).first()
    assert c["content"]["x0"] == 25.0 and rasters.ink(p).first()["ink"] > 0.1 and rasters.cleaned(p).first()["out_width"] == 200
    assert rasters.shadow_bands(p).count() == 0
    assert page_images.expanded([str(tmp_path), f"{tmp_path}/*.png"]) == [f"{tmp_path}/a.png", f"{tmp_path}/b.pgm"]
    assert page_images.output_path("out/", "x/book.png") == "out/book.pdf" and page_images.output_path("o.pdf", "b.png") == "o.pdf"


def test_stream_equals_batch(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    rows = pd.DataFrame({"doc_id": ["d", "d", "e", "d"], "page_index": pd.Series([0, 0, 1, 1], dtype="int32"), "params_json": ["{}"] * 4, "review_status": ["auto", "approved", "auto", "corrected"], "flags": [[], [], [], []], "updated_at": [1.0, 3.0, 1.0, 2.0]})
    source = f"{tmp_path}/in"
    d = spark.createDataFrame(rows, store.TABLES["pages"].schema)
    d.where("updated_at > 1.5").write.parquet(source)
    d.where("updated_at < 1.5").write.mode("append").parquet(source)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(source)
    decisions.into_store(stream, s, checkpoint=f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    want = store.latest(d, ["doc_id", "page_index"], [F.desc("updated_at")])
    assert sorted(map(tuple, s.pages().select("doc_id", "page_index", "review_status").collect())) == sorted(map(tuple, want.select("doc_id", "page_index", "review_status").collect()))


def test_stage_shares_and_turns(spark):
    t = spark.createDataFrame([("ocr", 3.0), ("render", 1.0)], "stage string, seconds double")
    assert [(r["stage"], r["percent"]) for r in features.stage_shares(t).collect()] == [("ocr", 75.0), ("render", 25.0)]
    p = spark.createDataFrame([("a", 10, 20), ("a", 10, 20), ("a", 20, 10), ("b", 20, 10), ("b", 10, 20)], "doc_id string, page_w int, page_h int")
    assert sorted((r["doc_id"], r["page_w"], r["turn"]) for r in features.orientation_fix(p).collect()) == [("a", 10, False), ("a", 10, False), ("a", 20, True), ("b", 10, False), ("b", 20, False)]


def test_sql_functions(spark):
    registry.register(spark)
    spark.createDataFrame([("a", 1.0, "p 12 of ３４"), ("a", 2.0, ""), ("a", 4.0, None), ("b", None, "1234567")], "g string, v double, t string").createOrReplaceTempView("sql_rows")
    got = {r["g"]: r["m"] for r in spark.sql("SELECT g, robust_mad(v) AS m FROM sql_rows GROUP BY g").collect()}
    assert got["a"] == pytest.approx(1.4826) and (got["b"] is None or got["b"] != got["b"])
    runs = spark.sql("SELECT x.number, x.start FROM sql_rows, LATERAL digit_runs(t) x").collect()
    assert sorted(map(tuple, runs)) == [(12, 2), (34, 8)]
    assert spark.sql("SELECT likeness('12', '12') AS l").first()["l"] == 1.0


def test_model_files_and_best_rows(spark, tmp_path):
    m = spark.createDataFrame([("bw", [1.0], [0.0], [1.0])], "label string, centre array<double>, mu array<double>, sd array<double>")
    learn.save(m, f"file://{tmp_path}/model")
    assert learn.load(spark, f"file://{tmp_path}/model").collect() == m.collect() and learn.load(spark, f"file://{tmp_path}/none") is None
    d = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, None)], "box int, pos int, conf double")
    assert sorted((r["box"], r["pos"]) for r in spatial.best_of(d, ["box"], "conf", "pos").collect()) == [(1, 1), (2, 0)]


def test_patch_kinds():
    kind = lambda g: pixels.patch_kind(pixels.patch_measures(np.asarray(g, np.uint8)))
    ramp = np.tile(np.linspace(30, 220, 120), (80, 1))
    rules = np.full((100, 100), 255)
    rules[::25], rules[:, ::25] = 0, 0
    assert kind(np.full((60, 60), 150)) == "solid_fill" and kind(ramp) == "photo" and kind(rules) == "line_art"
    assert kind(np.full((60, 60), 252)) == "other" and kind(np.full((4, 4), 0)) == "other" and kind(np.empty((0, 0))) == "other"
    assert kind(np.clip(np.random.default_rng(0).normal(128, 40, (80, 80)), 10, 245)) == "photo"
    letters = np.zeros((60, 300), bool)
    letters[20:32, 10:290:20] = letters[20:32, 11:290:20] = True
    assert pixels.has_line(letters) and not pixels.has_line(letters[:, :60])


def raster_rows(images):
    return [(doc, i, g.shape[0], g.shape[1], 1, 300.0, g.tobytes()) for doc, i, g in images]


def test_analysis_of_a_book(spark):
    words = bars()
    words[:, 350:370] = 255
    images = [("a", i, words) for i in range(9)] + [("a", 9, pixels.rotated(words, 3.0, 255)), ("b", 0, np.full((200, 300), 255, np.uint8))]
    d = spark.createDataFrame([*raster_rows(images), ("b", 1, 10, 10, 1, None, b"short")], page_images.SCHEMA)
    got = {(r["doc"], r["page_index"]): r for r in runs.analysed(d).collect()}
    assert len(got) == 12 and got["a", 0]["flags"] == [] and got["a", 0]["review_status"] == "auto"
    assert "deskew_low_confidence" in got["a", 9]["flags"] and got["a", 9]["review_status"] == "needs_review"
    assert got["b", 0]["blank"] and got["b", 0]["flags"] == [] and got["b", 1]["angle"] is None


def test_renormalising_numbering_and_learning(spark):
    rows = [(*page("a", i, (100.0, 100.0, 480.0, 680.0), w=600.0, h=800.0)[:-1], ["content_scaled_down_to_match_book", "x"]) for i in range(4)]
    p = spark.createDataFrame(rows, MARGIN.replace(", body struct<x0:double,y0:double,x1:double,y1:double>", ", flags array<string>"))
    r = spark.createDataFrame([], "doc string, page_index int, kind string, x0 double, y0 double, x1 double, y1 double")
    out = runs.renormalised(p, r).collect()
    assert all(o["flags"] == ["x"] and o["crop"]["x0"] <= 100 and o["target_w"] for o in out)
    leaves = spark.createDataFrame([("d", i, i, 1000.0, 1000.0, ["page_number_gap"]) for i in range(4)], "doc string, i long, page_index long, page_w double, page_h double, flags array<string>")
    cands = spark.createDataFrame([("d", i, 0, "bottom", "num", i + 5, str(i + 5), 500.0, 950.0, 530.0, 970.0) for i in range(4)], "doc string, i long, ord long, band string, kind string, v long, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((o["number"], o["nombre_text"], o["flags"]) for o in runs.numbered(leaves, cands).collect()) == [(i + 5, str(i + 5), []) for i in range(4)]
    region = lambda k: (k, (0.0, 0.0, 10.0, 10.0), "s", None, None, None, None)
    nested = spark.createDataFrame([("d", i, None, 300.0, (0.0, 1.0), None, [region("photo")] * 3 if i % 2 else [region("text")] * 30, "auto", [], "auto", "auto", None, None, False) for i in range(8)], features.PAGE_SCHEMA)
    f = features.learner_features(nested).select("page_index", F.array(*features.LEARNER_FIELDS).alias("v"), F.when(F.col("page_index") % 2 == 1, "color").otherwise("bw").alias("label"))
    kinds = {o["page_index"]: o["page_kind"] for o in runs.learned(nested, learn.centroids(f, "label", "v")).collect()}
    assert kinds == {i: "color" if i % 2 else "bw" for i in range(8)}


def test_ocr_scale(spark):
    d = spark.createDataFrame([(600.0, 10, 10), (None, 6000, 100), (300.0, 10, 10), (200.0, 100, 100)], "dpi double, h int, w int")
    assert [r[0] for r in d.select(page_images.ocr_scale(F.col("dpi"), F.col("h"), F.col("w"))).collect()] == [0.5, 0.5, 1.0, 1.0]
