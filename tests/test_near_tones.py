"""the SQL takes the earlier of tones whose distances differ by less than a hundredth a place."""

from leafmill.operators import tones


def test_nearly_equal_distances_go_to_the_earlier_tone(spark):
    hist = spark.createDataFrame([(1, 15, 3)], "zone long, gray int, n long")
    at = spark.createDataFrame([(1, 2, [10.0, 19.995])], "zone long, k int, tones array<double>")
    assert [tones._nearest(hist, at, ["zone"], n).first()["j"] for n in (0.0, 0.01, 0.001)] == [2, 1, 2]
