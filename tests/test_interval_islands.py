"""Intervals are merged over one sort: no table of islands in a task, nulls and reversed intervals as in the SQL."""

import random
import re

from pyspark.sql import functions as F

from leafmill.operators import margins, sequence


def brute(rows):
    """The SQL's rule row by row: an island begins where no end is known before or the start lies beyond all of them."""
    last = lambda x: (x is None, x or 0.0)
    out = {}
    for g in {r[0] for r in rows}:
        islands, reach = [], None
        for _, a, z in sorted((r for r in rows if r[0] == g), key=lambda r: (last(r[1]), last(r[2]))):
            if reach is None or (a is not None and a > reach):
                islands.append([])
            islands[-1].append((a, z))
            reach = max((e for e in (reach, z) if e is not None), default=None)
        for i, part in enumerate(islands, 1):
            out[g, i] = (min((a for a, _ in part if a is not None), default=None), max((z for _, z in part if z is not None), default=None), len(part))
    return out


def merged(spark, rows):
    df = spark.createDataFrame(rows, "g int, a double, z double").repartition(3)
    return {(r["g"], r["island"]): (r["a"], r["z"], r["parts"]) for r in sequence.merge_intervals(df, ["g"], "a", "z").collect()}


def test_no_table_of_islands(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0)], "g int, a double, z double")
    plan = sequence.merge_intervals(df, ["g"], "a", "z")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Aggregate", plan) and len(re.findall(r"\bSort\b", plan)) == 1


def test_nulls_and_reversed_intervals(spark):
    rows = [(1, 0.0, 10.0), (1, 20.0, 5.0), (1, 21.0, None), (1, None, 3.0), (2, 1.0, None), (2, 1.0, 4.0), (2, 4.0, 6.0), (3, None, None), (None, 1.0, 2.0), (None, 3.0, 4.0)]
    assert merged(spark, rows) == brute(rows)
    assert merged(spark, rows)[2, 1] == (1.0, 6.0, 3)


def test_many_intervals(spark):
    g = random.Random(5)
    value = lambda: None if g.random() < 0.05 else float(g.randrange(120))
    rows = [(g.randrange(40), a, None if a is None or g.random() < 0.05 else a + g.randrange(-3, 9)) for a in (value() for _ in range(900))]
    assert merged(spark, rows) == brute(rows)


def test_gaps_are_bridged(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 2.0), (1, 6.5, 7.0, 2.0), (2, 0.0, 1.0, 0.5), (2, 3.0, 4.0, 0.5)], "g int, a double, z double, far double")
    got = sequence.merge_intervals(df, ["g", "far"], "a", "z", gap=F.col("far")).drop("far").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0.0, 4.0, 2), (1, 2, 6.5, 7.0, 1), (2, 1, 0.0, 1.0, 1), (2, 2, 3.0, 4.0, 1)]


def test_body_boxes_keep_no_table_of_spans(spark):
    """Spans are merged by the same step."""
    pages = spark.createDataFrame([(1, 0, (0.0, 0.0, 100.0, 100.0))], "doc int, page_index int, content struct<x0:double,y0:double,x1:double,y1:double>")
    regions = spark.createDataFrame([(1, 0, "text", 5.0, 10.0, 90.0, 20.0)], "doc int, page_index int, kind string, x0 double, y0 double, x1 double, y1 double")
    body = margins.body_boxes(pages, regions)
    assert [tuple(r["body"]) for r in body.collect()] == [(5.0, 10.0, 90.0, 20.0)]
    assert "__open" in body._jdf.queryExecution().optimizedPlan().toString()
