"""F3 of round 4: tint zones by tiles that are closed and labelled at once, small graphs united in one task."""

import random

from pyspark.sql import functions as F

from leafmill.operators import graph, zones


def test_zones_and_holes_of_tiles_are_those_of_cells(spark, monkeypatch):
    g = random.Random(3)
    w, h = 37, 29
    cells = [(s, g.randrange(w), g.randrange(h)) for s, n in (("a", 300), ("b", 500), ("c", 120)) for _ in range(n)] + [("a", w, 1), ("a", -1, 2), ("z", 1, 1)]
    # A ring over tiles, its hole's first cell at the left edge of one.
    cells += [("d", x, y) for x in range(7, 30) for y in range(5, 25) if x == 7 or x == 29 or y in (5, 24)]
    c = spark.createDataFrame(cells, "sheet string, x long, y long")
    sheets = spark.createDataFrame([(s, w, h) for s in "abcde"], "sheet string, w long, h long")
    keys, rows = ["sheet"], lambda d: sorted(map(tuple, d.collect()))
    columns = ["sheet", "zone", "n", "x0", "y0", "x1", "y1"]
    for tile, radius, times in ((8, 1, 1), (5, 2, 2)):
        held = c.join(sheets, "sheet").where("x >= 0 AND x < w").select(*keys, "x", "y")
        plain = zones.labelled(zones.closed(held, sheets, keys, radius=radius, times=times, tile=tile), keys, tile=tile).localCheckpoint()
        size = rows(zones.measured(plain, keys).select(*columns))
        gaps = rows(zones.holes(plain, sheets, keys, tile=tile).select("hole", *columns))
        got, found = zones.closed_zones(c, sheets, keys, radius=radius, times=times, tile=tile)
        assert rows(got.select(*columns)) == size and rows(found.select("hole", *columns)) == gaps
        assert size and (gaps or times == 2) and len({r[0] for r in size}) == 4

    def never(*_, **__):
        raise AssertionError("rows of every cell are labelled")

    monkeypatch.setattr(zones, "labelled", never)
    monkeypatch.setattr(graph, "components", never)
    tint = c.withColumn("gray", F.lit(100).cast("long"))
    hints = spark.createDataFrame([("d", 1, 7.0, 5.0, 30.0, 25.0)], "sheet string, pos long, x0 double, y0 double, x1 double, y1 double")
    r = zones.tint_zones(tint, sheets, hints, hints.drop("pos").limit(0), keys, radius=1, times=1, tile=8).collect()
    assert [(x["sheet"], x["n"], x["x0"], x["y1"]) for x in r] == [("d", 2 * 23 + 2 * 18 + 4, 7, 25)]


def test_small_and_large_graphs(spark):
    g = random.Random(8)
    edges = [(s, g.randrange(n), g.randrange(n)) for s, n in (("a", 40), ("b", 900), ("c", 6)) for _ in range(n // 2)] + [("d", k, k + 1) for k in range(70)] + [("d", 3, 3)]
    d = spark.createDataFrame(edges, "sheet string, a long, b long")
    want = sorted(map(tuple, graph.components(d, ["sheet"]).collect()))
    for at_once in (1 << 20, 60):
        assert sorted(map(tuple, graph.united(d, ["sheet"], at_once=at_once).collect())) == want
