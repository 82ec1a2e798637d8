"""Zones, holes, closings and hysteresis against plain loops over whole sheets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from leafmill.operators import graph, zones


def flood(cells, diagonal=True):
    """{cell: least cell of its component by y, x}"""
    near = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    left, out = set(cells), {}
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start not in left:
            continue
        todo = [start]
        left.discard(start)
        while todo:
            x, y = todo.pop()
            out[x, y] = start
            for dx, dy in near:
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
    return out


def label(c):
    return (c[1] << 31) + c[0]


def plain_holes(cells, w, h):
    zone = flood(cells)
    gaps = flood({(x, y) for x in range(w) for y in range(h)} - set(cells), diagonal=False)
    groups = defaultdict(list)
    for c, first in gaps.items():
        groups[first].append(c)
    inner = {f: g for f, g in groups.items() if all(0 < x < w - 1 and 0 < y < h - 1 for x, y in g)}
    return sorted((label(zone[f[0] - 1, f[1]]), label(f), len(g)) for f, g in inner.items())


def plain_closed(cells, w, h, radius, times):
    disc = [(dx, dy) for dy, reach in zip(range(-radius, radius + 1), zones.disc(radius).tolist(), strict=True) for dx in range(-reach, reach + 1)]
    now = {c for c in cells if c[0] < w and c[1] < h}
    for _ in range(times):
        now = {(x + dx, y + dy) for x, y in now for dx, dy in disc if 0 <= x + dx < w and 0 <= y + dy < h}
    for _ in range(times):
        now = {(x, y) for x, y in now if all((x + dx, y + dy) in now or not (0 <= x + dx < w and 0 <= y + dy < h) for dx, dy in disc)}
    return now


def spiral(n):
    """One path that turns inward, one cell wide and one apart."""
    m, x, y, dx, dy = set(), 0, 0, 1, 0
    m.add((x, y))
    for k in range(2 * n):
        for _ in range(n - 1 - 2 * max(0, (k - 1) // 2) - (1 if k > 2 and k % 2 else 0)):
            if not (0 <= x + dx < n and 0 <= y + dy < n) or (x + 2 * dx, y + 2 * dy) in m:
                break
            x, y = x + dx, y + dy
            m.add((x, y))
        dx, dy = -dy, dx
    return m


def sheets():
    g = random.Random(3)
    yield "noise", {(g.randrange(33), g.randrange(29)) for _ in range(420)}
    yield "dense", {(x, y) for x in range(33) for y in range(29) if g.random() < 0.62}
    yield "spiral", spiral(27)
    yield "frame", {(x, y) for x in range(2, 30) for y in range(2, 26) if not (6 <= x < 24 and 6 <= y < 20)} | {(12, 12)}
    yield "checks", {(x, y) for x in range(33) for y in range(29) if (x + y) % 2}
    yield "one", {(5, 7)}


SHEETS = dict(sheets())


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(n, x, y, (x * 7 + y) % 50) for n, c in SHEETS.items() for x, y in c], "sheet string, x long, y long, gray long")


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(n, 33, 29) for n in SHEETS] + [("empty", 4, 4)], "sheet string, w long, h long")


@pytest.mark.parametrize(("diagonal", "tile"), [(True, 5), (True, 64), (False, 7)])
def test_labels_do_not_depend_on_tiles(cells, diagonal, tile):
    got = {(r["sheet"], r["x"], r["y"]): r["zone"] for r in zones.labelled(cells, ["sheet"], diagonal=diagonal, tile=tile).collect()}
    assert got == {(n, *c): label(f) for n, s in SHEETS.items() for c, f in flood(s, diagonal).items()}


def test_roots_of_one_mask():
    g = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.9):
        m = g.uniform(size=(40, 31)) < share
        for diagonal in (True, False):
            want = flood({(x, y) for y, x in zip(*map(list, np.nonzero(m)), strict=True)}, diagonal)
            at = zones.roots(m, diagonal)
            assert all(at[y, x] == (want[x, y][1] * 31 + want[x, y][0] if m[y, x] else -1) for y in range(40) for x in range(31))


def test_holes_belong_to_the_zone_around_them(cells, sizes):
    got = zones.holes(zones.labelled(cells, ["sheet"], tile=8), sizes, ["sheet"], tile=6).collect()
    for n, s in SHEETS.items():
        assert sorted((r["zone"], r["hole"], r["n"]) for r in got if r["sheet"] == n) == plain_holes(s, 33, 29)


@pytest.mark.parametrize(("radius", "times"), [(1, 1), (2, 2), (3, 1)])
def test_closing_equals_one_of_the_whole_sheet(cells, sizes, radius, times):
    got = defaultdict(set)
    for r in zones.closed(cells, sizes, ["sheet"], radius=radius, times=times, tile=9).collect():
        got[r["sheet"]].add((r["x"], r["y"]))
    for n, s in SHEETS.items():
        assert got[n] == plain_closed(s, 33, 29, radius, times), n


def test_weak_cells_stay_where_a_strong_one_is(cells):
    got = {(r["sheet"], r["x"], r["y"]) for r in zones.reaching(cells, ["sheet"], cells["gray"] < 2, tile=6).collect()}
    want = set()
    for n, s in SHEETS.items():
        zone = flood(s)
        strong = {zone[x, y] for x, y in s if (x * 7 + y) % 50 < 2}
        want |= {(n, *c) for c in s if zone[c] in strong}
    assert got == want


def test_odd_cells(spark):
    c = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 0, 2), ("a", -1, 0, 1), ("a", None, 3, 1), ("a", 1, 1, None), (None, 3, 3, 1)], "sheet string, x long, y long, zone_name long")
    got = {(r["sheet"], r["x"], r["y"], r["zone_name"], r["zone"]) for r in zones.labelled(c, ["sheet"], tile=4).collect()}
    assert got == {("a", 0, 0, 1, 0), ("a", 1, 1, None, 0), (None, 3, 3, 1, label((3, 3)))}
    assert zones.labelled(c.limit(0), ["sheet"]).collect() == []


def test_components_of_long_paths_and_stars(spark):
    g = random.Random(5)
    edges = [(k, k + 1) for k in range(1, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(g.randrange(3000, 3400), g.randrange(3000, 3400)) for _ in range(220)] + [(7, 7)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    d = spark.createDataFrame([("k", a, b) for a, b in edges], "part string, a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(d, ["part"]).collect()}
    assert got == {a: find(a) for a in parent if sum(a in e for e in edges if e[0] != e[1])}


# Tint zones -------------------------------------------------------------------------------------


def band(x0, y0, x1, y1):
    return {(x, y) for x in range(x0, x1) for y in range(y0, y1)}


def test_tint_zones_of_a_page(spark):
    """A frame of panels round a text, a badge with a caption, a stray blot, dark ink, and a hint without tint."""
    frame = band(10, 10, 130, 20) | band(10, 10, 20, 110) | band(10, 105, 130, 110) | band(120, 10, 130, 110)
    badge = band(150, 20, 180, 50) - band(155, 30, 175, 40)
    triangle = {(x, y) for x in range(150, 190) for y in range(70, 110) if x - 150 >= y - 70}
    gray = {c: 150 for c in frame | badge | triangle | band(3, 130, 9, 136)} | {c: 10 for c in band(60, 60, 70, 70)} | {c: 150 for c in band(40, 50, 100, 58)}
    cells = spark.createDataFrame([("p", x, y, v) for (x, y), v in gray.items()], "sheet string, x long, y long, gray long")
    page = spark.createDataFrame([("p", 200, 150)], "sheet string, w long, h long")
    hints = spark.createDataFrame([("p", k, *map(float, b)) for k, b in enumerate([(10, 10, 130, 20), (10, 10, 20, 110), (150, 20, 180, 50), (152, 72, 188, 108), (60, 130, 90, 148), (0, 0, 2, 2)])], "sheet string, pos long, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([("p", 40.0, 50.0, 100.0, 58.0)], "sheet string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["shape"], r["pos"], r["n"], r["holes"], r["hole_area"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in zones.tint_zones(cells, page, hints, texts, ["sheet"], radius=1, times=1, tile=32).collect()}
    inner, corners = len(band(20, 20, 120, 105)), 4  # a closing fills the corners of what it encloses
    assert got == {
        ("frame", None, len(frame) + corners, 1, inner - corners, 10, 10, 130, 110), ("poly", None, len(badge) + corners, 0, 0, 150, 20, 180, 50),
        ("poly", None, len(triangle), 0, 0, 150, 70, 190, 110), ("rect", 4, 540, 0, 0, 60, 130, 90, 148),
    }
