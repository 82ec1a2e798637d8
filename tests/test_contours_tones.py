"""Separation, contours and tones against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import contours, separation, tones
from tests.test_sheets import band, flood

BOX = "x0 double, y0 double, x1 double, y1 double"


def test_union_of_boxes_equals_a_raster(spark):
    g = random.Random(4)
    boxes = [(p, *(float(a), float(b), float(a + g.randrange(0, 12)), float(b + g.randrange(0, 9)))) for p in range(8) for a, b in ((g.randrange(30), g.randrange(30)) for _ in range(p * 5))]
    boxes += [(90, 0.0, 0.0, 5.0, 5.0)] * 3 + [(91, 5.0, 5.0, 1.0, 9.0), (92, None, 0.0, 1.0, 1.0), (None, 0.5, 0.5, 2.0, 2.0)]
    d = spark.createDataFrame(boxes, f"page int, {BOX}")
    got = {r["page"]: (r["n"], r["total"], r["covered"]) for r in separation.union_areas(d.where("page IS NOT NULL"), ["page"]).collect()}
    want = {}
    for p in {b[0] for b in boxes if b[0] is not None}:
        own = [b[1:] for b in boxes if b[0] == p and None not in b]
        if own:
            cells = {(x, y) for x0, y0, x1, y1 in own for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}
            want[p] = (len(own), sum(max(0, x1 - x0) * max(0, y1 - y0) for x0, y0, x1, y1 in own), float(len(cells)))
    assert got == want


def test_separated_page(spark):
    """Lines, a photo and a line drawing of the layout, furniture, a photo that nothing read, a speck, a bar at the frame."""
    g = random.Random(1)
    gray = {c: 40 for c in band(20, 20, 90, 26) | band(20, 32, 80, 38)} | {c: g.randrange(0, 250) for c in band(20, 60, 60, 90)} | {c: 10 for c in band(70, 60, 72, 90)}
    gray |= {c: 90 for c in band(100, 60, 130, 95)} | {c: 30 for c in band(140, 10, 143, 13)} | {c: 5 for c in band(0, 100, 150, 120)} | {c: 200 for c in band(100, 20, 130, 40)}
    pixels = spark.createDataFrame([("p", x, y, v) for (x, y), v in gray.items()], "doc string, x long, y long, gray long")
    pages = spark.createDataFrame([("p", 150, 120, 0.5, 150), ("none", 10, 10, 1.0, 150)], "doc string, w long, h long, scale double, threshold long")
    lines = spark.createDataFrame([("p", 1, "one", 0.9, 20.0, 20.0, 90.0, 26.0), ("p", 2, "", 0.8, 20.0, 32.0, 80.0, 38.0)], f"doc string, pos int, text string, conf double, {BOX}")
    layout = spark.createDataFrame([("p", 1, "figure", None, 20.0, 60.0, 60.0, 90.0), ("p", 2, None, None, 65.0, 58.0, 75.0, 92.0), ("p", 3, "page_number", "7", 15.0, 15.0, 95.0, 28.0), ("p", 4, "figure", None, 1.0, 1.0, 3.0, 9.0), ("p", 5, "text", "x", 0.0, 0.0, 50.0, 50.0)], f"doc string, pos int, label string, text string, {BOX}")
    regions, findings = separation.separated(pixels, pages, lines, layout, ["doc"], tile=32)
    got = {(r["kind"], r["source"], r["ocr_text"], r["layout_label"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in regions.collect()}
    assert got == {
        ("text", "line", "one", "page_number", 40, 40, 180, 52), ("text", "line", None, None, 40, 64, 160, 76), ("text", "layout", "7", "page_number", 30, 30, 190, 56),
        ("photo", "layout", None, None, 40, 120, 120, 180), ("figure", "layout", None, None, 130, 116, 150, 184), ("photo", "residual", None, None, 194, 114, 266, 196),
    }
    ink = sum(v <= 150 for v in gray.values())
    found = {r["doc"]: tuple(r)[1:] for r in findings.collect()}
    assert found == {"p": (ink, 9 + 150 * 20, False, (ink - 9 - 3000) / ink < 0.3), "none": (0, 0, True, False)}


# Contours ---------------------------------------------------------------------------------------


def plain_kept(p, error):
    def off(q, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = math.hypot(dx, dy)
        return abs(dx * (q[1] - a[1]) - dy * (q[0] - a[0])) / n if n else math.dist(q, a)

    def between(run):
        if len(run) < 3:
            return []
        d = [off(q, run[0], run[-1]) for q in run[1:-1]]
        k = d.index(max(d)) + 1
        return [*between(run[: k + 1]), run[k], *between(run[k:])] if d[k - 1] > error else []

    if len(p) < 3:
        return p
    d = [math.dist(q, p[0]) for q in p]
    far = d.index(max(d))
    if not far:
        return p[:1]
    return [p[0], *between(p[: far + 1]), p[far], *between([*p[far:], p[0]])]


def ring(n, seed, noise):
    g = random.Random(seed)
    return [(round(500 + (300 + noise * g.random()) * math.cos(2 * math.pi * k / n)), round(500 + (200 + noise * g.random()) * math.sin(2 * math.pi * k / n))) for k in range(n)]


POINTS = {"round": ring(120, 1, 9), "rough": ring(300, 2, 80), "box": [(0, 0), (5, 0), (9, 0), (9, 4), (9, 9), (3, 9), (0, 9), (0, 1)], "line": [(0, 0), (3, 0), (6, 0)], "same": [(2, 2)] * 5, "one": [(1, 1)], "none": []}


@pytest.mark.parametrize("error", [0.0, 1.5, 12.0])
def test_simplified_equals_plain_recursion(spark, error):
    d = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in p]) for n, p in POINTS.items()] + [("null", None)], "id string, points array<struct<x:long,y:long>>")
    got = {r["id"]: r["k"] and [tuple(q) for q in r["k"]] for r in d.select("id", contours.simplified(F.col("points"), F.lit(error)).alias("k")).collect()}
    assert {n: got[n] or [] for n in POINTS} == {n: plain_kept(p, error) for n, p in POINTS.items()} and got["null"] is None


def test_long_contours_need_no_recursion():
    k = np.arange(100_000)
    saw = np.stack([k, (k % 2) * 50], axis=1).astype(float)
    assert len(contours.kept(saw, 1.0)) > 99_000
    circle = np.round(np.stack([1e5 * np.cos(k * 2e-5 * np.pi), 1e5 * np.sin(k * 2e-5 * np.pi)], axis=1))
    few = contours.kept(circle, 3.0)
    assert 300 < len(few) < 1200 and len(contours.kept(np.zeros((9, 2)), 1.0)) == 1


def test_areas_and_lengths(spark):
    d = spark.createDataFrame([([{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 3}],), ([],), ([{"x": 1, "y": 1}],)], "p array<struct<x:long,y:long>>")
    got = [tuple(r) for r in d.select(contours.signed_area(F.col("p")), contours.perimeter(F.col("p")), contours.error_of(F.col("p"))).collect()]
    assert got == [(6.0, 12.0, 1.5), (0.0, 0.0, 1.5), (0.0, 0.0, 1.5)]
    r = spark.range(1).select(contours.scaled(contours.rectangle(F.lit(1), F.lit(2), F.lit(3), F.lit(5)), 0.5, 2.0).alias("p")).first()["p"]
    assert [tuple(q) for q in r] == [(1, 4), (2, 4), (2, 10), (1, 10)]


def nest(x0, y0, x1, y1, g, out, parent, depth):
    me = len(out)
    cut = g.randrange(0, 3)
    corner = [(x0 + cut, y0), (x1 - cut, y0), (x1, y0 + cut), (x1, y1 - cut), (x1 - cut, y1), (x0 + cut, y1), (x0, y1 - cut), (x0, y0 + cut)] if cut else [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    out.append((me, corner if g.random() < 0.5 else corner[::-1], parent, depth))
    if x1 - x0 > 24 and y1 - y0 > 24:
        mx, my = (x0 + x1) // 2, (y0 + y1) // 2
        for a, b, c, e in [(x0 + 4, y0 + 4, mx - 1, my - 1), (mx + 1, y0 + 4, x1 - 4, my - 1), (x0 + 4, my + 1, mx - 1, y1 - 4), (mx + 1, my + 1, x1 - 4, y1 - 4)]:
            if g.random() < 0.8:
                nest(a, b, c, e, g, out, me, depth + 1)


def test_nesting_of_random_trees_and_long_rows(spark):
    rows, want = [], {}
    for page in range(4):
        out = []
        nest(0, 0, 400, 300, random.Random(page), out, None, 0)
        nest(410, 5, 600, 290, random.Random(page + 9), out, None, 0)
        rows += [(page, k, [{"x": x, "y": y} for x, y in p]) for k, p, *_ in out]
        want |= {(page, k): (parent, depth) for k, _, parent, depth in out}
    # A row of squares side by side in one frame: parents come over long chains.
    square = lambda x, y, s: [{"x": a, "y": b} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]
    rows += [(7, 0, square(0, 0, 900))] + [(7, k, square(5 * k, 10, 3)) for k in range(1, 150)] + [(8, k, square(k, k, 200 - 2 * k)) for k in range(90)]
    want |= {(7, 0): (None, 0)} | {(7, k): (0, 1) for k in range(1, 150)} | {(8, k): (k - 1 if k else None, k) for k in range(90)}
    d = spark.createDataFrame(rows, "page int, contour int, points array<struct<x:long,y:long>>")
    assert {(r["page"], r["contour"]): (r["parent"], r["depth"]) for r in contours.nested(d, ["page"]).collect()} == want
    assert contours.nested(d.limit(0), ["page"]).collect() == []


def test_cells_inside_and_coverage(spark):
    shapes = [(0, "a", [(2, 2), (20, 2), (20, 18), (2, 18)]), (0, "hole", [(6, 6), (12, 6), (12, 12), (6, 12)]), (0, "wedge", [(30, 0), (60, 0), (30, 30)])]
    d = spark.createDataFrame([(p, c, [{"x": x, "y": y} for x, y in q]) for p, c, q in shapes], "page int, contour string, points array<struct<x:long,y:long>>")
    got = {(r["x"], r["y"]) for r in contours.cells_inside(d, ["page"]).collect()}
    want = (band(2, 2, 20, 18) - band(6, 6, 12, 12)) | {(x, y) for x in range(30, 60) for y in range(30) if x - 30 + 0.5 + y + 0.5 < 30}
    assert got == want
    tint = spark.createDataFrame([(0, x, y) for x, y in band(0, 0, 10, 10)] + [(5, 1, 1)], "page int, x long, y long")
    miss = len(band(0, 0, 10, 10) - want)
    assert {tuple(r) for r in contours.coverage(tint, d, ["page"]).collect()} == {(0, 100, miss, len(want) - 100 + miss, 100.0 - miss), (5, 1, 1, 0, 0.0)}


# Tones ------------------------------------------------------------------------------------------


def plain_tones(pixels, numbers, reach, share, least, rounds):
    pixels = sorted(v for v in pixels if v < 255)
    n = len(pixels)
    for k in numbers if n >= least else ():
        t = [float(pixels[(2 * j + 1) * n // (2 * k)]) for j in range(k)]
        place = lambda v, t: min(range(len(t)), key=lambda j: (abs(t[j] - v), j))
        for _ in range(rounds):
            held = [[] for _ in t]
            for v, c in Counter(pixels).items():
                held[place(v, t)] += [v] * c
            t = [sum(h) / len(h) if h else m for h, m in zip(held, t, strict=True)]
        good = sum(abs(v - math.floor(t[place(v, t)] + 0.5)) <= reach for v in pixels)
        if good >= share * n:
            return k, [math.floor(x + 0.5) for x in t], good, n
    return None


def test_tones_equal_a_plain_loop(spark):
    g = random.Random(8)
    zones = {f"z{k}": [min(255, max(0, round(g.gauss(g.choice([50, 100, 150, 200, 235][: k + 1]), 6)))) for _ in range(400)] for k in range(5)}
    zones |= {"wide": [g.randrange(256) for _ in range(500)], "few": [90] * 99, "flat": [90] * 100, "white": [255] * 300, "two": [10] * 97 + [200] * 3}
    d = spark.createDataFrame([(z, v) for z, p in zones.items() for v in p] + [("flat", None)], "zone string, gray int")
    for numbers, share in ((tones.NUMBERS, tones.SHARE), (tones.FLAT_NUMBERS, tones.FLAT_SHARE)):
        got = {r["zone"]: (r["k"], [int(t) for t in r["tones"]], r["good"], r["n"]) for r in tones.chosen(d, ["zone"], numbers=numbers, share=share).collect()}
        want = {z: plain_tones(p, numbers, tones.REACH, share, tones.LEAST_PIXELS, tones.ROUNDS) for z, p in zones.items()}
        assert got == {z: t for z, t in want.items() if t}


def test_flat_zones_need_even_tiles(spark):
    g = random.Random(2)
    rows = [("even", x, y, 120 + g.randrange(5)) for x in range(40) for y in range(40)] + [("slope", x, y, 20 + 5 * x) for x in range(40) for y in range(40)]
    d = spark.createDataFrame(rows, "zone string, x long, y long, gray int")
    assert [r["zone"] for r in tones.flat(d, ["zone"], tile=8).collect()] == ["even"]


def test_flood_helper():
    assert flood({(0, 0), (1, 1)}) == {(0, 0): (0, 0), (1, 1): (0, 0)} and len(set(flood({(0, 0), (1, 1)}, False).values())) == 2
