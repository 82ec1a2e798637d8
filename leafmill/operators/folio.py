"""Page-number resolution: candidates vote for the offset between printed number and page index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.sequence import gaps

LEAST_VOTES, VOTE_SHARE, OVERRUN = 3, 0.3, 50


def candidates(folio: DataFrame) -> DataFrame:
    """Readings that can be page numbers of their book, with their offset. One pass, no self-join."""
    pages = F.count("*").over(Window.partitionBy("book_id"))
    return folio.withColumn("pages", pages).where((F.col("v") > 0) & (F.col("v") <= F.col("pages") + OVERRUN)).withColumn("off", F.col("v") - F.col("page_index"))


def votes(folio: DataFrame) -> DataFrame:
    return candidates(folio).groupBy("book_id", "kind", "off").agg(F.count("*").alias("votes"), F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"))


def primary_clusters(folio: DataFrame) -> DataFrame:
    """Offsets with enough votes in themselves and beside the strongest of their book and kind."""
    most = F.max("votes").over(Window.partitionBy("book_id", "kind"))
    return votes(folio).withColumn("__m", most).where((F.col("votes") >= LEAST_VOTES) & (F.col("votes") >= VOTE_SHARE * F.col("__m"))).drop("__m")


def assigned(folio: DataFrame) -> DataFrame:
    """One number a page: of its candidates in primary clusters the one with the most votes, then least offset."""
    held = candidates(folio).join(primary_clusters(folio).select("book_id", "kind", "off", "votes"), ["book_id", "kind", "off"])
    rank = Window.partitionBy("book_id", "kind", "page_index").orderBy(F.desc("votes"), "off")
    return held.withColumn("__r", F.row_number().over(rank)).where("__r = 1").select("book_id", "kind", "page_index", "v", "off", "votes")


def gap_report(folio: DataFrame) -> DataFrame:
    """Printed numbers that are missing between neighbouring assigned pages."""
    return gaps(assigned(folio), ["book_id", "kind"], "page_index", "v")


def position_model(folio: DataFrame) -> DataFrame:
    """Median place of the number on left and right pages, of books with enough assigned pages."""
    side = F.pmod("page_index", F.lit(2)).alias("side")
    return folio.groupBy("book_id", side).agg(F.count("*").alias("n"), F.median("x").alias("x"), F.median("y").alias("y")).where(F.col("n") >= LEAST_VOTES)
