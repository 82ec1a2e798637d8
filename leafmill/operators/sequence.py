"""Sequence logic over ordered pages: runs, bridged runs, gaps, interval merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], order: str, flag: str, *, bridge: int = 0) -> DataFrame:
    """Maximal runs of rows with ``flag``: first, last, length. Breaks of up to ``bridge`` positions are closed."""
    w = Window.partitionBy(*by).orderBy(order)
    on = df.where(F.col(flag))
    fresh = (F.col(order) - F.lag(order).over(w) > bridge + 1) | F.lag(order).over(w).isNull()
    marked = on.withColumn("__new", fresh.cast("int")).withColumn("run", F.sum("__new").over(w))
    return marked.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def gaps(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Places where ``value`` rises by more than the positions do: at, prev_value, value, missing."""
    w = Window.partitionBy(*by).orderBy(order, value)
    stepped = df.withColumn("prev_value", F.lag(value).over(w)).withColumn("__p", F.lag(order).over(w))
    missing = (F.col(value) - F.col("prev_value")) - (F.col(order) - F.col("__p"))
    return stepped.where((F.col(value) > F.col("prev_value")) & (missing >= 1)).select(*by, order, "prev_value", value, missing.alias("missing"))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, *, gap: Column | None = None) -> DataFrame:
    """Unions of overlapping or touching intervals per group, also of those at most ``gap`` apart; nulls come last.

    Running values over one sort, of which the last row of each island is kept: a task holds the sort, which can
    spill, and no table of its islands, which are nearly as many as its rows.
    """
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(reach.isNull() | (F.col(start) > (reach if gap is None else reach + gap)), F.lit(False))
    rows = df.select(*by, start, end, F.row_number().over(w).alias("__at"), fresh.alias("__new"))
    opened = F.last(F.when(F.col("__new"), F.struct("__at", F.col(start).alias("start"))), ignorenulls=True).over(upto)
    island = F.sum(F.col("__new").cast("int")).over(upto)
    rows = rows.select(*by, end, "__at", island.alias("island"), opened.alias("__open"), F.lead("__new", 1, True).over(w).alias("__last"), start)
    # Islands only rise, so the greatest pair holds the greatest end of the present one, also where an end lies before its start.
    reached = F.max(F.struct("island", F.col(end).alias("end"))).over(upto)
    return rows.withColumn("__end", reached["end"]).where("__last").select(
        *by, "island", F.col("__open")["start"].alias(start), F.col("__end").alias(end), (F.col("__at") - F.col("__open")["__at"] + 1).cast("long").alias("parts")
    )


def closed(df: DataFrame, by: list[str], order: str, flag: str, gap: int) -> DataFrame:
    """``df`` with ``closed``: the flag, also on breaks of up to ``gap`` positions between rows that have it."""
    w = Window.partitionBy(*by).orderBy(order)
    at = F.when(F.col(flag), F.col(order))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("closed", F.coalesce(F.col(flag) | (after - before - 1 <= gap), F.lit(False)))


def dark_bands(profile: DataFrame, by: list[str], page: str, bin: str, *, bins: int = 1000, share: float = 0.5, widest: float = 0.05, least_pages: int = 8) -> DataFrame:
    """``by``, lo, hi: bands of an axis that are dark on ``share`` of a book's pages, as shares of the axis.

    ``profile`` has one row a page and dark bin. Books under ``least_pages`` pages have no band; runs of bins wider
    than ``widest`` of the axis are content.
    """
    pages = profile.groupBy(*by).agg(F.countDistinct(page).alias("__pages")).where(F.col("__pages") >= least_pages)
    dark = profile.groupBy(*by, bin).agg(F.countDistinct(page).alias("__on")).join(pages, by).where(F.col("__on") >= share * F.col("__pages"))
    found = runs(dark.withColumn("__flag", F.lit(True)), by, bin, "__flag").where(F.col("length") <= widest * bins)
    return found.select(*by, (F.col("first") / bins).alias("lo"), ((F.col("last") + 1) / bins).alias("hi"))


def page_numbers(spec: str | None) -> list[tuple[int, int]] | None:
    """Closed ranges of a selection like ``9,52,236-237``; None, for all pages, without one."""
    parts = [p.strip() for p in (spec or "").split(",") if p.strip()]
    out = [(int(a), int(z or a)) for a, _, z in (p.partition("-") for p in parts)]
    return [(a, z) for a, z in out if a <= z] or None


def selected_pages(df: DataFrame, page: str, spec: str | None) -> DataFrame:
    """The rows whose page the selection names; ranges are predicates, which reach the scan."""
    ranges = page_numbers(spec)
    if ranges is None:
        return df
    keep = F.lit(False)
    for a, z in ranges:
        keep = keep | F.col(page).between(a, z)
    return df.where(keep)
