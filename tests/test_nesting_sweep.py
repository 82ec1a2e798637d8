"""nesting in one sweep, without tables between rounds."""

from leafmill.operators import contours


def test_touching_contours_without_tables_between(spark, monkeypatch):
    box = lambda x0, y0, x1, y1: [{"x": a, "y": b} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    # 2 begins where 1 ends, 4 within 2, 3 within 1; 5 is a line.
    rows = [(1, 0, box(0, 0, 90, 300)), (1, 1, box(5, 5, 30, 250)), (1, 2, box(30, 5, 60, 250)), (1, 3, box(8, 100, 20, 200)), (1, 4, box(33, 100, 50, 200)), (1, 5, box(35, 150, 40, 150)), (1, 6, [])]
    d = spark.createDataFrame(rows, "page int, contour int, points array<struct<x:long,y:long>>")

    def never(*_):
        raise AssertionError("a checkpoint was written")

    monkeypatch.setattr(type(d), "checkpoint", never)
    got = {r["contour"]: (r["parent"], r["depth"]) for r in contours.nested(d, ["page"]).collect()}
    assert got == {0: (None, 0), 1: (0, 1), 2: (0, 1), 3: (1, 2), 4: (2, 2), 5: (4, 3)}
