"""F1 of round 4: a crop's size is not taken from its rounded edges."""

from pyspark.sql import functions as F

from leafmill.operators import margins
from tests.test_pages import MARGIN, page


def test_crops_as_large_as_their_target_are_not_scaled(spark):
    # Unreliable pages get the target's size; far down on a page its edges lie less exactly than its size.
    rows = [page("a", i, (10.0 + i / 3, 540000.0 + i / 7, 700.0 + i / 3, 540900.0 + i / 7), dpi=300.0 + 100 * (i % 3), conf=0.8 if i % 2 else 0.1) for i in range(60)]
    pages = spark.createDataFrame(rows, MARGIN)
    n = margins.normalise(pages).join(pages.select("doc", "page_index", "dpi", "confidence"), ["doc", "page_index"])
    t = margins.transform(F.lit(1200.0), F.lit(10000.0), F.lit(0.3), F.col("crop"), F.col("target_w"), F.col("target_h"), F.col("dpi"), 600, size=(F.col("crop_w"), F.col("crop_h")))
    got = [r for r in n.withColumn("t", t).collect() if r["confidence"] < margins.RELIABLE]
    assert len(got) == 30 and any(r["crop"]["y1"] - r["crop"]["y0"] > r["target_h"] for r in got)
    assert [r["t"]["scale"] for r in got] == [600.0 / r["dpi"] for r in got]
