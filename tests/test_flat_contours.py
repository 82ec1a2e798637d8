"""contours are simplified on Arrow's flat values, not on an object a point."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from leafmill.operators import contours


def test_simplified_on_flat_values(spark):
    assert contours._simplified.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    g = np.random.default_rng(3)
    rows = [(k, [(int(x), int(y)) for x, y in g.integers(0, 40, (k, 2))], 2.0) for k in range(30)] + [(90, None, 1.0), (91, [(0, 0), (4, 0), (8, 0)], None), (92, [(0, 0), None, (None, 3), (5, 0), (5, 5)], 1.0)]
    d = spark.createDataFrame(rows, "k int, p array<struct<x:long,y:long>>, e double").repartition(2)
    got = {r["k"]: None if r["q"] is None else [tuple(q) for q in r["q"]] for r in d.select("k", contours.simplified(F.col("p"), F.col("e")).alias("q")).collect()}
    for k, p, e in rows[:30]:
        assert got[k] == [p[i] for i in contours.kept(np.array(p, float).reshape(-1, 2), e)]
    assert got[90] is None and got[91] is None and got[92] == [(0, 0), (5, 0), (5, 5)]
