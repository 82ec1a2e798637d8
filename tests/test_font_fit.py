"""the fitting share is found among few, as among all."""

import random

from pyspark.sql import functions as F

from leafmill.functions import drawing


def test_few_shares_are_tried_and_equal_all(spark):
    g = random.Random(5)
    rows = [(g.uniform(0.01, 9), g.uniform(0, 200), g.uniform(0.5, 60)) for _ in range(3000)] + [(1.0, 0.5 * k, 50.0) for k in range(120)] + [(0.0, 3.0, 2.0), (-1.0, 3.0, 2.0), (1e-300, 3.0, 2.0), (1.0, -2.0, 4.0), (1.0, 1e18, 4.0)]
    d = spark.createDataFrame(rows, "u double, w double, h double")
    got = d.select("u", "w", "h", drawing.font_fit(*map(F.col, ("u", "w", "h"))).alias("r")).collect()
    for r in got:
        assert r["r"] == min((abs(r["u"] * r["h"] * (i / 50.0) - r["w"]), i / 50.0) for i in range(1, 51))[1]
    assert d.select(drawing.font_fit(F.lit(None).cast("double"), F.col("w"), F.col("h")).alias("r")).first()["r"] == 0.02
