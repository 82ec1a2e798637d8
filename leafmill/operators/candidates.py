"""Page-number candidates: text regions in the margin bands and what numbers they may print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import numerals

#: Share of the page's height that the top and the bottom band take.
BAND = 0.14
BOX = ("x0", "y0", "x1", "y1")


def band_of(y0: Column, y1: Column, page_h: Column) -> Column:
    """top, bottom or null by the box's centre."""
    at = (y0 + y1) / 2
    return F.when(at <= page_h * BAND, "top").when(at >= page_h * (1 - BAND), "bottom")


def numeral_candidates(regions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ord, band, kind, v, text, box and region columns of each reading of a text region in a band.

    ``regions`` has ``keys``, pos (its place on the page), ocr_text, a box and page_h. A region is a number
    (``num``), else a roman one (``roman``), else the digits it starts and ends with, each with its part of the
    box; else ``unparsed`` with no value. Regions without text or outside both bands give no row.
    """
    t = F.col("ocr_text")
    whole = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("stop"))
    reading = lambda kind, v, text, part: F.struct(F.lit(kind).alias("kind"), v.cast("long").alias("v"), text.alias("text"), part["start"].alias("start"), part["stop"].alias("stop"))
    fused = F.transform(F.col("__fused"), lambda x: reading("num", x["v"], x["v"].cast("string"), x))
    readings = (
        F.when(F.col("__num") > 0, F.array(reading("num", F.col("__num"), t, whole)))
        .when(F.col("__rom") > 0, F.array(reading("roman", F.col("__rom"), t, whole)))
        .when((F.size("__fused") > 0) & (F.col("x1") > F.col("x0")), fused)
        .otherwise(F.array(reading("unparsed", F.lit(None), t, whole)))
    )
    held = regions.where(F.coalesce(t, F.lit("")) != "").withColumn("band", band_of(F.col("y0"), F.col("y1"), F.col("page_h"))).where("band is not null")
    held = held.withColumns({"__num": numerals.numeral(t), "__rom": numerals.roman_as_read(t), "__fused": numerals.fused_digits(t)})
    each = held.select("*", F.posexplode(readings).alias("__k", "r"))
    w = F.col("x1") - F.col("x0")
    return each.select(
        *keys, (F.col("pos") * 2 + F.col("__k")).cast("long").alias("ord"), "band", "r.kind", "r.v", "r.text",
        (F.col("x0") + w * F.col("r.start")).alias("x0"), "y0", (F.col("x0") + w * F.col("r.stop")).alias("x1"), "y1", F.struct(*BOX).alias("region"),
    )
