"""F6, F8: a zone that fills just the least share of its box is a photo."""

from leafmill.operators import separation

BOX = "x0 double, y0 double, x1 double, y1 double"


def test_zone_of_exactly_the_least_share(spark):
    # 18 cells of a box of 6 by 15: 0.2 * 6 * 15 is a little over 18 in doubles.
    cells = {(2 + min(k, 5), 2 + k) for k in range(15)} | {(6, 16), (6, 15), (6, 14)}
    assert len(cells) == 18
    pixels = spark.createDataFrame([(1, x, y, 10) for x, y in cells], "sheet long, x long, y long, gray long")
    pages = spark.createDataFrame([(1, 30, 30, 1.0, 150)], "sheet long, w long, h long, scale double, threshold long")
    lines = spark.createDataFrame([], f"sheet long, pos long, text string, conf double, {BOX}")
    layout = spark.createDataFrame([], f"sheet long, pos long, label string, text string, {BOX}")
    regions, findings = separation.separated(pixels, pages, lines, layout, ["sheet"])
    assert [(r["kind"], r["source"]) for r in regions.collect()] == [("photo", "residual")]
    assert [(r["ink"], r["lost"]) for r in findings.collect()] == [(18, 0)]
