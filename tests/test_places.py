"""Place clusters and greedy choice of boxes against plain loops."""

import random
from collections import defaultdict

from leafmill.operators import spatial


def plain_places(rows, near_x=0.055, near_y=0.030, least=3, least_offset=2):
    """Rows (i, ord, band, kind, v, fx, fy) of one book; the means are worked out anew from all members."""
    places = []
    for r in sorted((r for r in rows if r[4] is not None), key=lambda r: (r[0], r[1])):
        x, y = min(r[5], 1 - r[5]), r[6]
        best = None
        for p in places:
            if p[0][2] == r[2]:
                mx, my = (sum(v) / len(p) for v in ([min(q[5], 1 - q[5]) for q in p], [q[6] for q in p]))
                if abs(x - mx) <= near_x and abs(y - my) <= near_y:
                    d = abs(x - mx) / near_x + abs(y - my) / near_y
                    best = (d, p) if best is None or d < best[0] - 1e-12 else best
        if best:
            best[1].append(r)
        else:
            places.append([r])
    chosen, top = [], 0
    for p in places:
        pages = defaultdict(set)
        for r in p:
            pages[r[3], r[4] - r[0]].add(r[0])
        support, seen = max(map(len, pages.values())), len({r[0] for r in p})
        xs, ys = [min(r[5], 1 - r[5]) for r in p], [r[6] for r in p]
        score = 4 * support + seen - 20 * (max(xs) - min(xs) + max(ys) - min(ys))
        if seen >= least and support >= least_offset and score > top:
            chosen, top = p, score
    return chosen


def test_places_equal_a_plain_loop(spark):
    rows = []
    for doc in range(14):
        g = random.Random(doc)
        spots = [(g.random(), g.choice([0.05, 0.94]), g.choice(["top", "bottom"])) for _ in range(g.randrange(1, 5))]
        for i in range(g.randrange(2, 40)):
            for k in range(g.randrange(0, 4)):
                x, y, band = g.choice(spots)
                rows.append((doc, i, k, band, g.choice(["num", "num", "roman"]), g.choice([i + 3, i + 3, i + 3, g.randrange(50), None]), min(1, max(0, x + g.gauss(0, 0.02))), y + g.gauss(0, 0.008)))
    d = spark.createDataFrame(rows, "doc int, i int, ord int, band string, kind string, v int, fx double, fy double")
    got = defaultdict(set)
    for r in spatial.position_clusters(d).collect():
        got[r["doc"]].add((r["i"], r["ord"]))
    want = {doc: {(r[0], r[1]) for r in plain_places([r[1:] for r in rows if r[0] == doc])} for doc in range(14)}
    assert dict(got) == {k: v for k, v in want.items() if v} and len(got) > 8


def test_greedy_choice_of_long_chains(spark):
    """Boxes that each overlap the next hang on each other, so every second one stays; with random crowds beside."""
    g = random.Random(3)
    rows = [("chain", k, 10.0 * k, 0.0, 10.0 * k + 40, 40.0) for k in range(12)] + [("same", k, 5.0, 5.0, 9.0, 9.0) for k in range(30)]
    rows += [("crowd", k, x := float(g.randrange(40)), y := float(g.randrange(40)), x + g.randrange(1, 30), y + g.randrange(1, 30)) for k in range(300)]

    def same(a, b):
        inner = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return inner > 0 and inner / max(1.0, area(a) + area(b) - inner) > spatial.NMS_IOU

    kept = []
    for r in sorted(rows, key=lambda r: (r[3], r[2], (r[4] - r[2]) * (r[5] - r[3]), r[1])):
        if not any(k[0] == r[0] and same(k, r) for k in kept):
            kept.append(r)
    d = spark.createDataFrame(rows, "page string, pos int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, spatial.distinct_boxes(d, ["page"], cell=16.0).collect())) == sorted(kept) and {r[1] for r in kept if r[0] == "chain"} == set(range(0, 12, 2))
    assert spatial.distinct_boxes(d.limit(0), ["page"]).collect() == []
