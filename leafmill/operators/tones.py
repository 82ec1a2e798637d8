"""Few flat tones for zones of gray pixels: k-means over histograms, with the number of tones chosen by a gate.

All numbers of tones are worked on at once: a zone's histogram (256 rows at most) is copied for each, and a round is one
sum over it that Spark combines before it shuffles, however many pixels a zone has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITE, LEAST_PIXELS, ROUNDS = 255, 100, 10
NUMBERS, REACH, SHARE = (2, 3, 4, 5, 6), 15, 0.95
#: The same for large zones of printed dots, which are looked at as tiles.
FLAT_NUMBERS, FLAT_SHARE, FLAT_TILE, FLAT_SPREAD = (1, 2, 3, 4), 0.70, 64, 28.0


def histogram(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gray, n of drawable pixels; white is paper."""
    return pixels.where(F.col("gray") < WHITE).groupBy(*keys, F.col("gray").cast("int").alias("gray")).agg(F.count("*").alias("n"))


def seeds(hist: DataFrame, keys: list[str], numbers: tuple[int, ...]) -> DataFrame:
    """keys, k, tones: for each number k of tones the gray values at the middles of k equal shares of the pixels."""
    upto = Window.partitionBy(*keys).orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = hist.withColumns({"z": F.sum("n").over(upto), "all": F.sum("n").over(whole)}).withColumn("a", F.col("z") - F.col("n"))
    at = h.select(*keys, "gray", "a", "z", "all", F.explode(F.array(*map(F.lit, numbers))).alias("k")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    # Middle j of k is the pixel at floor((2 j + 1) all / 2 k).
    place = F.floor((2 * F.col("j") + 1) * F.col("all") / (2 * F.col("k")))
    return at.where((place >= F.col("a")) & (place < F.col("z"))).groupBy(*keys, "k").agg(F.sort_array(F.collect_list(F.col("gray").cast("double"))).alias("tones"))


def _nearest(hist: DataFrame, tones: DataFrame, keys: list[str], near: float = 0.0) -> DataFrame:
    """``hist`` with k, tones and the place ``j`` of the nearest tone, the first of equals.

    A tone goes before a later one that is nearer by less than ``near`` a place.
    """
    d = F.transform("tones", lambda t, i: F.abs(t - F.col("gray")) * (1 / near) + i if near else F.abs(t - F.col("gray")))
    return hist.join(tones, keys).withColumn("d", d).withColumn("j", F.array_position("d", F.array_min("d")).cast("int")).drop("d")


def fitted(hist: DataFrame, keys: list[str], numbers: tuple[int, ...], *, rounds: int = ROUNDS, near: float = 0.0) -> DataFrame:
    """keys, k, tones after ``rounds`` of moving each tone to the mean of its pixels; a tone without any stays."""
    tones = seeds(hist, keys, numbers)
    for _ in range(rounds):
        held = _nearest(hist, tones, keys, near).groupBy(*keys, "k", "tones", "j").agg((F.sum(F.col("gray") * F.col("n")) / F.sum("n")).alias("m"))
        moved = held.groupBy(*keys, "k", "tones").agg(F.map_from_entries(F.collect_list(F.struct("j", "m"))).alias("m"))
        tones = moved.select(*keys, "k", F.transform("tones", lambda t, i: F.coalesce(F.try_element_at("m", i + 1), t)).alias("tones"))
    return tones


def chosen(pixels: DataFrame, keys: list[str], *, numbers: tuple[int, ...] = NUMBERS, reach: int = REACH, share: float = SHARE, least: int = LEAST_PIXELS, rounds: int = ROUNDS, near: float = 0.0) -> DataFrame:
    """keys, k, tones, good, n of each zone: the fewest tones, rounded, that lie within ``reach`` of ``share`` of its pixels.

    Zones under ``least`` drawable pixels, and those that no number fits, have no row. Pixels need keys and gray.
    """
    hist = histogram(pixels.where("gray IS NOT NULL"), keys)
    held = _nearest(hist, fitted(hist, keys, numbers, rounds=rounds, near=near), keys, near)
    off = F.abs(F.col("gray") - F.round(F.element_at("tones", F.col("j"))))
    gate = held.groupBy(*keys, "k", "tones").agg(F.sum(F.when(off <= reach, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"))
    fit = gate.where((F.col("n") >= least) & (F.col("good") >= share * F.col("n"))).groupBy(*keys).agg(F.min_by(F.struct("tones", "good", "n"), "k").alias("b"), F.min("k").alias("k"))
    return fit.select(*keys, "k", F.transform("b.tones", lambda t: F.round(t)).alias("tones"), "b.good", "b.n")


def flat(pixels: DataFrame, keys: list[str], *, tile: int = FLAT_TILE, spread: float = FLAT_SPREAD, reach: int = REACH) -> DataFrame:
    """``chosen`` with looser gates for zones whose tiles' medians lie within ``spread`` of each other (their middle half)."""
    place = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in ("x", "y")]
    medians = pixels.where(F.col("gray") < WHITE).groupBy(*keys, *place).agg(F.median("gray").alias("m"))
    even = medians.groupBy(*keys).agg((F.percentile("m", 0.75) - F.percentile("m", 0.25)).alias("s")).where(F.col("s") <= spread)
    return chosen(pixels, keys, numbers=FLAT_NUMBERS, share=FLAT_SHARE, reach=reach).join(even.select(*keys), keys, "left_semi")
