"""what is made of exploded cells is never broadcast through the driver."""

from leafmill.operators import zones


def test_zones_and_holes_join_by_shuffle(spark):
    # Ranges, as Spark knows their size and would broadcast them.
    cells = spark.range(81).selectExpr("0L AS sheet", "id % 9 AS x", "id DIV 9 AS y", "100L AS gray").where("NOT (x = 4 AND y = 4) AND NOT (x = 7 AND y = 2)")
    sheets = spark.range(1).selectExpr("id AS sheet", "9 AS w", "9 AS h")
    found = zones.holes(zones.labelled(cells, ["sheet"], tile=4), sheets, ["sheet"], tile=4)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["x0"], r["y0"], r["n"]) for r in found.collect()) == [(4, 4, 1), (7, 2, 1)]
