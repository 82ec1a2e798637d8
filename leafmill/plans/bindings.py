"""The driver's tables read as the page model, in DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def b_page(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, d, "events").select(
        F.col("user_id").cast("long").alias("book_id"),
        (F.row_number().over(order) - 1).cast("long").alias("page_index"),
        ((F.col("value") - 50) / 50).alias("angle"),
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long").alias("k"),
        "event_type",
    )


def b_folio(spark: SparkSession, d: str) -> DataFrame:
    p = b_page(spark, d)
    printed = F.col("page_index") + 1 + F.col("book_id") % 5 + F.when(F.col("page_index") > 40, 3).otherwise(0)
    return p.select(
        "book_id", "page_index", F.when(F.col("event_type") == "error", F.col("k")).otherwise(printed).alias("v"),
        F.when(F.col("event_type") == "signup", "roman").otherwise("num").alias("kind"),
    )


def b_region(spark: SparkSession, d: str) -> DataFrame:
    x0, y0 = (F.col("l_partkey") % 800).cast("double"), (F.col("l_suppkey") * 9).cast("double")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("page"),
        (F.col("l_linenumber").cast("long") * 1000003 + F.col("l_partkey").cast("long") * 7 + F.col("l_suppkey").cast("long")).alias("rid"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 4 * F.col("l_quantity")).alias("x1"), (y0 + F.col("l_quantity")).alias("y1"),
        F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("source"),
    )


def b_decision(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("user_id").cast("long").alias("doc"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long").alias("page_index"),
        F.col("event_type").alias("field"), F.col("value").alias("new_value"), F.col("ts").alias("created_at"), F.col("event_id").cast("long").alias("id"),
    )


def b_scope(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    r = read(spark, d, "region")
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select(
        F.col("c_mktsegment").alias("scanner"), F.col("o_orderpriority").alias("fmt"), F.col("o_orderstatus").alias("genre"),
        F.col("r_name").alias("writing"), F.round(F.col("o_totalprice") * 100).cast("long").alias("metric"),
    )


def b_gray(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_returnflag", F.least(F.floor(F.col("l_extendedprice") / 500), F.lit(255)).cast("long").alias("gray"))


SQL = """b_page AS (SELECT CAST(user_id AS BIGINT) AS book_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS page_index, (value - 50) / 50 AS angle, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, event_type FROM events),
b_folio AS (SELECT book_id, page_index, CASE WHEN event_type = 'error' THEN k ELSE page_index + 1 + book_id % 5 + CASE WHEN page_index > 40 THEN 3 ELSE 0 END END AS v, CASE WHEN event_type = 'signup' THEN 'roman' ELSE 'num' END AS kind FROM b_page),
b_region AS (SELECT CAST(l_orderkey AS BIGINT) AS page, CAST(l_linenumber AS BIGINT) * 1000003 + CAST(l_partkey AS BIGINT) * 7 + CAST(l_suppkey AS BIGINT) AS rid, CAST(l_partkey % 800 AS DOUBLE) AS x0, CAST(l_suppkey * 9 AS DOUBLE) AS y0, CAST(l_partkey % 800 AS DOUBLE) + 4 * l_quantity AS x1, CAST(l_suppkey * 9 AS DOUBLE) + l_quantity AS y1, l_returnflag AS kind, l_linestatus AS source FROM lineitem),
b_decision AS (SELECT CAST(user_id AS BIGINT) AS doc, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS page_index, event_type AS field, value AS new_value, ts AS created_at, CAST(event_id AS BIGINT) AS id FROM events),
b_scope AS (SELECT c_mktsegment AS scanner, o_orderpriority AS fmt, o_orderstatus AS genre, r_name AS writing, CAST(round(o_totalprice * 100) AS BIGINT) AS metric FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b_gray AS (SELECT l_returnflag, least(CAST(floor(l_extendedprice / 500) AS BIGINT), 255) AS gray FROM lineitem)"""
