"""the matrix's sums run from left to right, as in the SQL."""

import random

from pyspark.sql import functions as F

from leafmill.operators import margins


def test_sums_run_from_left_to_right(spark):
    g = random.Random(2)
    rows = [tuple(g.uniform(1, 900) for _ in range(6)) + (g.uniform(-1, 1),) for _ in range(2000)]
    d = spark.createDataFrame(rows, "x0 double, y0 double, w double, h double, tw double, th double, turn double")
    crop = F.struct("x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    t = margins.transform(F.lit(1200.0), F.lit(10000.0), F.col("turn"), crop, F.col("tw"), F.col("th"), F.lit(600.0), 600)
    for r in d.select("x0", "w", "h", "y0", t.alias("t"), F.cos(F.radians("turn")).alias("a"), F.sin(F.radians("turn")).alias("b")).collect():
        s, w = r["t"]["scale"], (r["x0"] + r["w"]) - r["x0"]
        assert r["t"]["m"][2] == s * ((1 - r["a"]) * 600.0 - r["b"] * 5000.0) + (r["t"]["out_w"] - w * s) / 2 - s * r["x0"]
