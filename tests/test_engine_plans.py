"""a result that is parsed from JSON is parsed once a row, also in filters that Spark derives."""

from pyspark.sql import functions as F

from leafmill.functions import engines


def test_results_are_parsed_once_a_row(spark):
    json = '{"rec_boxes": [[0,1,2,3],[4,5,6,7]], "rec_texts": ["a",""], "layout_det_res": {"boxes": [{"label": "Table", "coordinate": [0,0,1,1], "score": 0.5}]}}'
    d = spark.createDataFrame([(json,)], "j string").repartition(1).select(F.from_json("j", engines.RESULT_SCHEMA).alias("res"))
    c = d.select(engines.composite(engines.recognised_lines(F.col("res"), "e"), engines.layout_boxes(F.col("res"), "e")).alias("c"))
    for part, parsed in (("lines", 3), ("layout", 3)):
        rows = c.select(F.posexplode(f"c.{part}").alias("pos", "x"))
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= parsed
    assert [(r["x"]["text"], r["x"]["box"]["x0"]) for r in c.select(F.posexplode("c.lines").alias("pos", "x")).collect()] == [("a", 0.0), (None, 4.0)]
