"""Hierarchical profiles: statistics of every scope and look-up that backs off to wider ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_lattice(df: DataFrame, fixed: str, soft: list[str], value: str) -> DataFrame:
    """Count and mean of ``value`` for each subset of the soft dimensions; '*' stands for a dimension left out."""
    names = [F.when(F.grouping(c) == 1, F.lit("*")).otherwise(F.col(c)).alias(f"{c}_scope") for c in soft]
    sets = [[fixed, *(c for k, c in enumerate(soft) if bits >> k & 1)] for bits in range(1 << len(soft))]
    levels = df.groupingSets([[F.col(c) for c in s] for s in sets], fixed, *soft).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), *names)
    return levels.select(fixed, *(F.col(f"{c}_scope").alias(c) for c in soft), "n", "mean")


def back_off(asked: DataFrame, lattice: DataFrame, fixed: str, soft: list[str], *, least: int) -> DataFrame:
    """For each asked scope the narrowest level with ``least`` rows, dropping the last dimension first."""
    out = asked
    found = []
    for depth in range(len(soft), -1, -1):
        level = lattice.where(reduce(lambda a, b: a & b, [F.col(c) == "*" for c in soft[depth:]], F.lit(True)))
        level = level.where(reduce(lambda a, b: a & b, [F.col(c) != "*" for c in soft[:depth]], F.col("n") >= least))
        level = level.select(fixed, *soft[:depth], F.struct(F.lit(depth).alias("depth"), "n", "mean").alias(f"__l{depth}"))
        out = out.join(level, [fixed, *soft[:depth]], "left")
        found.append(F.col(f"__l{depth}"))
    best = F.coalesce(*found)
    return out.select(fixed, *soft, best["depth"].cast("long").alias("depth"), best["n"].alias("n"), best["mean"].alias("mean"))


#: The soft dimensions that each level of ``resolve`` keeps, finest first, as places in its list of three.
LEVELS = ((0, 1, 2), (0, 1), (0, 2), (1, 2), (0,), (1,), (2,), ())


def resolve(asked: DataFrame, lattice: DataFrame, fixed: str, soft: list[str], *, least: int) -> DataFrame:
    """For each asked scope the first of LEVELS with ``least`` rows, else the coarsest whatever its rows.

    Null in a soft dimension of an asked scope skips the levels that keep it; null equals null in ``fixed``.
    """
    out, found = asked.select(fixed, *soft), []
    for k, places in enumerate(LEVELS):
        held = [soft[i] for i in places]
        level = lattice.where(reduce(lambda a, b: a & b, [(F.col(c) != "*") if c in held else (F.col(c) == "*") for c in soft]))
        if held:
            level = level.where(F.col("n") >= least)
        level = level.select(*(F.col(c).alias(f"__{c}{k}") for c in (fixed, *held)), F.struct(F.lit(k).alias("level"), "n", "mean").alias(f"__l{k}"))
        same = [F.col(fixed).eqNullSafe(F.col(f"__{fixed}{k}")), *(F.col(c) == F.col(f"__{c}{k}") for c in held)]
        out = out.join(level, reduce(lambda a, b: a & b, same), "left").drop(*(f"__{c}{k}" for c in (fixed, *held)))
        found.append(F.col(f"__l{k}"))
    best = F.coalesce(*found)
    return out.select(fixed, *soft, best["level"].cast("long").alias("level"), best["n"].alias("n"), best["mean"].alias("mean"))
