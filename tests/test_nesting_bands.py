"""F2 of round 4: nesting by bands, whose sides are moved once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.operators import batches, contours


def square(x0, y0, x1, y1):
    return [{"x": a, "y": b} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def boxes(page, x0, y0, x1, y1, g, depth, parent, out):
    """Boxes within a box, of which ``out`` keeps page, contour, points, parent, depth."""
    at = x0 + 1
    while depth < 5 and at < x1 - 3 and y1 - y0 > 4:
        end = min(x1 - 1, at + g.randint(2, max(3, (x1 - x0) // 2)))
        top = g.randint(y0 + 1, y1 - 3)
        low = g.randint(top + 1, y1 - 1)
        out.append((page, len(out), square(at, top, end, low), parent, depth))
        boxes(page, at, top, end, low, g, depth + 1, len(out) - 1, out)
        at = end + g.randint(1, 9)


def test_boxes_in_many_bands(spark, monkeypatch):
    g, rows = random.Random(4), []
    for page in (0, 1, None):
        boxes(page, -300, -700, 900, 800, g, 0, None, rows)
    want = {r[1]: (None, 0) if r[0] is None else (r[3], r[4]) for r in rows}
    assert len(rows) > 200 and max(d for _, d in want.values()) > 2
    # One without width and one without height lie beside the others and hold nothing.
    rows += [(0, -1, square(-400, -900, -400, 900), None, 0), (0, -2, square(-500, 5, -450, 5), None, 0)]
    want |= {-1: (None, 0), -2: (None, 0)}
    d = spark.createDataFrame([r[:3] for r in rows], "page int, contour int, points array<struct<x:long,y:long>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = contours.nested(d.repartition(3), ["page"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
        assert {r["contour"]: (r["parent"], r["depth"]) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # In one process, with few meetings at once.
    monkeypatch.setattr(contours, "MET", 5)
    one = d.withColumn("contour", F.col("contour").cast("string")).toArrow().to_batches()
    sides = pa.concat_tables([contours._upright(b, ["page"]) for b in one])
    band = [list(range(a >> 6, (max(a, z - 1) >> 6) + 1)) for a, z in zip(*(sides.column(c).to_pylist() for c in ("y0", "y1")), strict=True)]
    placed = sides.take([i for i, b in enumerate(band) for _ in b]).append_column("band", pa.array([k for b in band for k in b], pa.int64())).sort_by([("page", "ascending"), ("band", "ascending")])
    got = [r for t in batches.whole_groups(placed.to_batches(max_chunksize=3), ["page", "band"]) for s in contours._swept(t, ["page"]) for r in s.to_pylist()]
    assert {int(r["contour"]): (r["parent"] and int(r["parent"]), r["depth"]) for r in got} == want and len(got) == len(want)
