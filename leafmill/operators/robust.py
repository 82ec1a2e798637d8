"""Book-level robust statistics: exact medians and MADs, percentiles, modes, outlier flags."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
SKEW_PAGES, SKEW_ANGLE, SKEW_SIGMAS, SKEW_FLOOR = 8, 0.5, 2.0, 0.10
NEGLIGIBLE_ANGLE, GOOD_CONFIDENCE = 0.2, 1.5


def robust_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, med, mad (scaled) and p975 of ``value`` per group. Two aggregations on one partitioning.

    For groups whose distinct values fit a task, as a book's do; ``exact_quantiles`` is for larger ones.
    """
    centre = df.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("med"), F.percentile(value, F.lit(0.975)).alias("p975"))
    spread = df.join(centre.select(*by, "med"), by).groupBy(*by).agg((MAD_SCALE * F.median(F.abs(F.col(value) - F.col("med")))).alias("mad"))
    return centre.join(spread, by).select(*by, "n", "med", "mad", "p975")


#: Accuracy of the sketches that bracket an order statistic.
SKETCH = 10_000


def _beside(df: DataFrame, few: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``few``, which has one row a group and is broadcast; null keys meet."""
    keys = {c: f"__key{i}" for i, c in enumerate(by)}
    on = functools.reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(keys[c])), by, F.lit(True))
    return df.join(F.broadcast(few.withColumnsRenamed(keys)), on, how).drop(*keys.values())


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """``by``, n, q0, q1, ...: exact interpolated quantiles of few groups of any size.

    A sketch, summed map-side, gives bounds that the wanted ranks cannot lie outside of (its error is at
    most 1/SKETCH of the rows). A second pass, beside which the groups' bounds are broadcast, counts map-side: each
    value between a pair of bounds by itself, some ten-thousandths of a group at most, all that lies between two
    such pairs as one. So rows are neither moved nor sorted, and running sums of the counts are the ranks. Groups under
    ten times SKETCH rows are counted value by value. Nulls do not count.
    """
    held = df.select(*by, F.col(value).cast("double").alias("__v"))
    marks = sorted({min(1.0, max(0.0, s + e / SKETCH)) for s in shares for e in (-3, 3)})
    cuts = held.groupBy(*by).agg(F.count("__v").alias("n"), F.percentile_approx("__v", [float(m) for m in marks], SKETCH).alias("__q"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    place = {m: i for i, m in enumerate(marks)}

    def bound(s: float, e: int) -> Column:
        m = min(1.0, max(0.0, s + e / SKETCH))
        end = F.col("__lo") if e < 0 else F.col("__hi")
        # In small groups a sketch's share is less than a row; they are counted whole.
        return end if m in (0, 1) else F.when(F.col("n") < 10 * SKETCH, end).otherwise(F.col("__q")[place[m]])

    cuts = cuts.select(*by, "n", *(bound(s, e).alias(f"__{n}{k}") for k, s in enumerate(shares) for n, e in (("a", -3), ("z", 3))))
    v, pairs = F.col("__v"), [(F.col(f"__a{k}"), F.col(f"__z{k}")) for k in range(len(shares))]
    inside = functools.reduce(lambda x, y: x | y, (v.between(a, z) for a, z in pairs))
    # What lies outside stands right after the last upper bound below it, or before everything.
    under = functools.reduce(lambda x, z: F.when((z < v) & (z > x), z).otherwise(x), (z for _, z in pairs), F.lit(float("-inf")))
    rows = _beside(held.where("__v is not null"), cuts, by).select(*by, F.when(inside, v).otherwise(under).alias("__v"), (~inside).alias("__rest"))
    counts = rows.groupBy(*by, "__v", "__rest").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("__v", "__rest").rowsBetween(Window.unboundedPreceding, 0))
    ranked = _beside(counts.withColumn("__upto", upto), cuts.select(*by, "n"), by).where("not __rest")
    at = lambda r: F.max(F.when((r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")), v))
    ranks = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ends = ranked.groupBy(*by).agg(*(at(f(r)).alias(f"__{n}{k}") for k, r in enumerate(ranks) for n, f in (("low", F.floor), ("high", F.ceil))))
    out = []
    for k, rank in enumerate(ranks):
        low, high = F.col(f"__low{k}"), F.col(f"__high{k}")
        between = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
        out.append(F.when(F.ceil(rank) == F.floor(rank), low).otherwise(between).alias(f"q{k}"))
    return _beside(cuts.select(*by, "n"), ends, by, "left").select(*by, "n", *out)


def large_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, med, mad (scaled) and p975 as ``robust_stats``, by ``exact_quantiles``: for few groups of any size."""
    held = df.select(*by, F.col(value).cast("double").alias("__x"))
    centre = exact_quantiles(held, by, "__x", (0.5, 0.975)).withColumnsRenamed({"q0": "med", "q1": "p975"})
    off = _beside(held, centre.select(*by, "med"), by).select(*by, F.abs(F.col("__x") - F.col("med")).alias("__d"))
    spread = exact_quantiles(off, by, "__d", (0.5,)).select(*by, (MAD_SCALE * F.col("q0")).alias("mad"))
    return _beside(centre, spread, by, "left").select(*by, "n", "med", "mad", "p975")


def robust_outliers(df: DataFrame, by: list[str], value: str, *, k: float = 3.5, least_rows: int = 8) -> DataFrame:
    """Rows further than ``k`` scaled MADs from their group's median; groups under ``least_rows`` have none."""
    s = robust_stats(df, by, value)
    return df.join(s, by).where((F.col("n") >= least_rows) & (F.col("mad") > 0) & (F.abs(F.col(value) - F.col("med")) > k * F.col("mad")))


def skew_flags(df: DataFrame, by: list[str], angle: str, confidence: str) -> DataFrame:
    """Pages whose deskew should be reviewed.

    In groups of SKEW_PAGES or more pages an angle of SKEW_ANGLE or more that lies further than SKEW_SIGMAS
    deviations from the median, the deviation at least SKEW_FLOOR. In smaller groups an angle that is not
    negligible and has little confidence; an unknown confidence is none.
    """
    s = robust_stats(df, by, angle).select(*by, "n", "med", "mad")
    far = F.abs(F.col(angle) - F.col("med")) > SKEW_SIGMAS * F.greatest("mad", F.lit(SKEW_FLOOR))
    of_group = far & (F.abs(angle) >= SKEW_ANGLE)
    of_page = (F.abs(angle) >= NEGLIGIBLE_ANGLE) & (F.coalesce(confidence, F.lit(0.0)) < GOOD_CONFIDENCE)
    return df.join(s, by).where(F.when(F.col("n") >= SKEW_PAGES, of_group).otherwise(of_page))


def first_seen_mode(df: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first in ``order``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("votes"), F.min(order).alias("__first"))
    rank = Window.partitionBy(*by).orderBy(F.desc("votes"), "__first")
    return counts.withColumn("__r", F.row_number().over(rank)).where("__r = 1").select(*by, value, "votes")


def otsu(df: DataFrame, by: list[str], gray: str) -> DataFrame:
    """First threshold of 0..255 with the largest between-class variance, class 0 at or under it."""
    hist = df.groupBy(*by, gray).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(gray).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    w0, s0 = F.sum("n").over(upto), F.sum(F.col("n") * F.col(gray)).over(upto)
    w, s = F.sum("n").over(whole), F.sum(F.col("n") * F.col(gray)).over(whole)
    at = hist.select(*by, gray, w0.alias("w0"), s0.alias("s0"), (w - w0).alias("w1"), (s - s0).alias("s1"))
    gap = F.col("s0") / F.col("w0") - F.col("s1") / F.col("w1")
    score = F.round(F.col("w0").cast("double") * F.col("w1") * gap * gap, 3)
    best = Window.partitionBy(*by).orderBy(F.desc("score"), gray)
    return at.where("w1 > 0").withColumn("score", score).withColumn("r", F.row_number().over(best)).where("r = 1").select(*by, F.col(gray).alias("threshold"))


INK_HIGH, INK_FLOOR, INK_LEAST, SHOW_THROUGH = 225, 110, 0.001, 25


def ink_valley(thresholds: DataFrame, by: list[str]) -> DataFrame:
    """The median of the pages' thresholds of each book, cut to a whole number."""
    return thresholds.groupBy(*by).agg(F.floor(F.median("threshold")).cast("long").alias("valley"))


def ink_thresholds(pixels: DataFrame, by: list[str], page: str, gray: str) -> DataFrame:
    """``by``, page, with_book, alone: gray values up to which a pixel is ink.

    With the book's valley a threshold far above it gives way to it; alone a very high one gives way to INK_FLOOR
    if next to no pixel is that dark.
    """
    own = otsu(pixels, [*by, page], gray)
    dark = pixels.groupBy(*by, page).agg(F.avg((F.col(gray) <= INK_FLOOR).cast("double")).alias("dark"))
    t = F.col("threshold")
    return own.join(dark, [*by, page]).join(ink_valley(own, by), by).select(
        *by, page, F.when(t > F.col("valley") + SHOW_THROUGH, F.col("valley")).otherwise(t).alias("with_book"),
        F.when((t > INK_HIGH) & (F.col("dark") < INK_LEAST), F.lit(INK_FLOOR)).otherwise(t).alias("alone"),
    )


def tile_quality(pixels: DataFrame, tone: float, *, tile: int = 32, least: float = 40.0) -> DataFrame:
    """tx, ty, off, n of the tiles whose pixels (x, y, gray) lie ``least`` or more from ``tone`` on average, worst first."""
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    each = pixels.groupBy(at("x").alias("tx"), at("y").alias("ty")).agg(F.avg(F.abs(F.col("gray") - tone)).alias("off"), F.count("*").alias("n"))
    return each.where(F.col("off") >= least).orderBy(F.desc("off"), "tx", "ty")
