"""Contours as arrays of points: simplification, nesting, areas, and the cells inside.

``points`` is array<struct<x,y>> of whole numbers, closed from its last point to its first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from leafmill.operators.batches import codes, ddl, fresh, whole_groups

POINTS = ArrayType(StructType().add("x", LongType()).add("y", LongType()))
#: Largest distance of a point that goes, as a share of the contour's length, within these pixels.
ERROR_SHARE, ERROR_LEAST, ERROR_MOST = 0.003, 1.5, 3.0
#: Rows of a band, which is swept by itself, and meetings of sides and rows that are held at once.
BAND_BITS = 6
BAND = 1 << BAND_BITS
MET = 1 << 21


def _sides(points: Column) -> Column:
    """Each point with its next, the last with the first."""
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.element_at(points, F.when(i + 1 < n, i + 2).otherwise(1)).alias("b")))


def signed_area(points: Column) -> Column:
    """Shoelace sum; positive for points that go clockwise where y points down."""
    return F.when(F.size(points) > 0, F.aggregate(_sides(points), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)).otherwise(F.lit(0.0))


def perimeter(points: Column) -> Column:
    dx, dy = (lambda e: e["b"]["x"] - e["a"]["x"]), (lambda e: e["b"]["y"] - e["a"]["y"])
    return F.when(F.size(points) > 0, F.aggregate(_sides(points), F.lit(0.0), lambda s, e: s + F.sqrt((dx(e) * dx(e) + dy(e) * dy(e)).cast("double")))).otherwise(F.lit(0.0))


def scaled(points: Column, sx: float, sy: float) -> Column:
    """Points times a factor, to whole pixels, half away from zero."""
    return F.transform(points, lambda p: F.struct(F.round(p["x"] * sx).cast("long").alias("x"), F.round(p["y"] * sy).cast("long").alias("y")))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The contour of a box."""
    corner = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def _distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of points from the line through a and b, from a where both are one."""
    d, r = b - a, p - a
    length = np.hypot(*d)
    return np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / length if length else np.hypot(r[:, 0], r[:, 1])


def kept(p: np.ndarray, error: float) -> np.ndarray:
    """Places of the points that stay: the first, the one furthest from it, and between kept ones any whose distance
    from their line is the largest and over ``error``; the first of equals. Spans wait on a stack of their own."""
    n = len(p)
    if n < 3:
        return np.arange(n)
    far = int(np.hypot(*(p - p[0]).T).argmax())
    ring, stay = np.vstack([p, p[:1]]), {0, far}
    todo = [(0, far), (far, n)] if far else []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = _distance(ring[a + 1 : b], ring[a], ring[b])
        k = int(d.argmax())
        if d[k] > error:
            stay.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(stay))


@F.arrow_udf(POINTS)
def _simplified(points: pa.Array, error: pa.Array) -> pa.Array:
    """On the flat coordinates of a batch: no point becomes an object of Python."""
    flat, starts = points.values, points.offsets.to_numpy()
    x, y = (flat.field(c) for c in ("x", "y"))
    good = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (flat, x, y)])
    at = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for c in (x, y)], axis=1)
    taken, stops = [], [0]
    known = points.is_valid().to_numpy(zero_copy_only=False) & error.is_valid().to_numpy(zero_copy_only=False)
    for k, (a, z, e) in enumerate(zip(starts[:-1], starts[1:], error.fill_null(0).to_numpy(zero_copy_only=False), strict=True)):
        if known[k]:
            own = a + np.flatnonzero(good[a:z])
            taken.append(own[kept(at[own], e)])
        stops.append(stops[-1] + (len(taken[-1]) if known[k] else 0))
    values = flat.take(pa.array(np.concatenate(taken) if taken else np.empty(0, np.int64)))
    offsets = pa.array(stops, pa.int32(), mask=np.append(~known, False)) if len(known) else pa.array([0], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([values.field(c).cast(pa.int64()) for c in ("x", "y")], ["x", "y"]))


def error_of(points: Column) -> Column:
    return F.greatest(F.lit(ERROR_LEAST), F.least(F.lit(ERROR_MOST), ERROR_SHARE * perimeter(points)))


def simplified(points: Column, error: Column | None = None) -> Column:
    """``points`` without those that lie within ``error`` of the lines that stay; null points are left out first."""
    return _simplified(points, (error_of(points) if error is None else error).cast("double"))


def crossings(contours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, contour, row, x: where each side of a contour (keys, contour, points) meets the middle of a row of pixels."""
    side = contours.select(*keys, "contour", F.explode(_sides(F.col("points"))).alias("s"))
    low = lambda c: F.when(F.col("s.a.y") <= F.col("s.b.y"), F.col(f"s.a.{c}")).otherwise(F.col(f"s.b.{c}"))
    high = lambda c: F.when(F.col("s.a.y") <= F.col("s.b.y"), F.col(f"s.b.{c}")).otherwise(F.col(f"s.a.{c}"))
    side = side.select(*keys, "contour", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1")).where("y1 > y0")
    rows = side.withColumn("row", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    return rows.select(*keys, "contour", "row", (F.col("x0") + (F.col("row") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))


def _upright(rows: pa.RecordBatch, keys: list[str]) -> pa.Table:
    """keys, contour, x0, y0, x1, y1, ask: the sides of contours that are not level, each from its lower y; those that begin in
    the contour's first row ask for what lies around it. A contour without such sides asks by a side without height."""
    points = rows.column("points")
    flat, owner = pc.list_flatten(points), pc.list_parent_indices(points).to_numpy()
    x, y = (pc.struct_field(flat, c) for c in ("x", "y"))
    good = (x.is_valid().to_numpy(zero_copy_only=False)) & (y.is_valid().to_numpy(zero_copy_only=False))
    owner, (x, y) = owner[good], (c.cast(pa.int64()).fill_null(0).to_numpy()[good] for c in (x, y))
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    after = np.arange(1, len(owner) + 1)
    if len(start):
        after[np.append(start[1:], len(owner)) - 1] = start
    low = y <= y[after]
    x0, y0, x1, y1 = (np.where(low, *ends) for ends in ((x, x[after]), (y, y[after]), (x[after], x), (y[after], y)))
    size = np.diff(np.append(start, len(owner)))
    top = np.minimum.reduceat(y, start) if len(start) else y
    first = np.repeat(top, size)
    left = np.minimum.reduceat(np.where(y == first, x, np.iinfo(np.int64).max), start) if len(start) else x
    up = y1 > y0
    level = ~(np.logical_or.reduceat(up, start) if len(start) else up)
    at = pa.array(np.concatenate([owner[up], owner[start][level]]))
    out = {c: rows.column(c).take(at) for c in (*keys, "contour")}
    for name, side, one in (("x0", x0, left), ("y0", y0, top), ("x1", x1, left), ("y1", y1, top)):
        out[name] = pa.array(np.concatenate([side[up], one[level]]), pa.int64())
    return pa.table(out | {"ask": pa.array(np.concatenate([(y0 == first)[up], np.ones(level.sum(), bool)]))})


def _swept(rows: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The asking contours of bands of ``_upright`` sides with parent and depth; some MET meetings are held at once."""
    x0, y0, x1, y1, band = (rows.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "band"))
    group, contour = np.cumsum(fresh(rows, [*keys, "band"])), codes(rows.column("contour"))
    within = lambda y: group * BAND + np.clip(y - band * BAND, 0, BAND)
    asks = np.flatnonzero(rows.column("ask").to_numpy() & (y0 >> BAND_BITS == band))
    if not len(asks):
        return
    asked, first, row = np.unique(within(y0)[asks], return_index=True, return_inverse=True)
    y = y0[asks][first]
    # A contour asks where its first row is met first.
    place = x0 + 0.5 * (x1 - x0) / np.maximum(y1 - y0, 1)
    order = np.lexsort((place[asks], contour[asks], row))
    asks, row = asks[order], row[order]
    one = np.append(True, (np.diff(row) != 0) | (np.diff(contour[asks]) != 0))
    asks, row = asks[one], row[one]
    known = np.logical_and.reduce([rows.column(k).is_valid().to_numpy() for k in keys])
    a = np.searchsorted(asked, within(y0))
    z = np.where(known, np.searchsorted(asked, within(y1)), a)
    meetings = np.cumsum(np.bincount(a, minlength=len(asked) + 1) - np.bincount(z, minlength=len(asked) + 1))[:-1]
    cuts = np.flatnonzero(np.diff(np.cumsum(meetings) // MET, prepend=0))
    for lo, hi in itertools.pairwise(np.unique(np.concatenate([[0], cuts, [len(asked)]])).tolist()):
        held = np.flatnonzero((a < hi) & (z > lo) & (a < z))
        begin, n = np.maximum(a[held], lo), np.minimum(z[held], hi) - np.maximum(a[held], lo)
        side = np.repeat(held, n)
        at = np.arange(len(side)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        x = x0[side] + (y[at] + 0.5 - y0[side]) * (x1[side] - x0[side]) / (y1[side] - y0[side])
        # Along a row a contour's sides open and close in turn; where both meet, nothing lies between.
        turn = np.lexsort((x, contour[side], at))
        opens, closes = turn[::2], turn[1::2]
        wide = x[closes] > x[opens]
        opens, closes = opens[wide], closes[wide]
        mine = (row >= lo) & (row < hi)
        k, m = len(opens), int(mine.sum())
        what = np.concatenate([side[opens], side[closes], asks[mine]])
        line = np.concatenate([at[opens], at[closes], row[mine]])
        spot = np.concatenate([x[opens], x[closes], place[asks[mine]]])
        other = np.concatenate([x[closes], x[opens], np.zeros(m)])
        step = np.repeat(np.array([1, -1, 0]), [k, k, m])
        # At one place sides close, inner ones first, then points ask, then sides open, outer ones first.
        order = np.lexsort((-other, step, spot, line))
        what, line, step = what[order], line[order], step[order]
        depth = np.cumsum(step)
        level = line * (depth.max(initial=0) + 1) + depth
        order = np.argsort(level, kind="stable")
        level, step = level[order], step[order]
        last = np.maximum.accumulate(np.where(step > 0, np.arange(len(step)), -1))
        ask = np.flatnonzero(step == 0)
        around = last[ask]
        inside = (around >= 0) & (level[around] == level[ask])
        own, parent = what[order][ask], pa.array(what[order][around], mask=~inside)
        out = {c: rows.column(c).take(pa.array(own)) for c in (*keys, "contour")}
        yield pa.table(out | {"parent": rows.column("contour").take(parent), "depth": pa.array(depth[order][ask], pa.int64())})


def nested(contours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, contour, parent, depth: the nearest contour around each one, null and 0 outside of all.

    Contours (whole numbers, keys and contour together unique) do not cross, so along a row their sides open and close
    like brackets. A sweep along the row under a contour's topmost point counts the open ones, which is its depth;
    the last that opened at that depth is its parent. Sides are moved once, to the bands of rows that they pass, and each
    band is swept by itself in the rows in which contours begin: a task holds the sides of one band. A contour without
    height or width has no inside, and where a key is null nothing lies around.
    """
    names = [*keys, "contour"]
    real = contours.select(*names, "points")
    schema = f"{ddl(real.select(*names))}, x0 long, y0 long, x1 long, y1 long, ask boolean"
    sides = real.mapInArrow(lambda batches: (b for rows in batches for b in _upright(rows, keys).to_batches()), schema)
    band = F.sequence(F.shiftright("y0", BAND_BITS), F.shiftright(F.greatest("y0", F.col("y1") - 1), BAND_BITS))
    placed = sides.withColumn("band", F.explode(band)).repartition(*keys, "band").sortWithinPartitions(*keys, "band")
    out = f"{ddl(real.select(*names, F.col('contour').alias('parent')))}, depth long"
    return placed.mapInArrow(lambda batches: (b for rows in whole_groups(batches, [*keys, "band"]) for t in _swept(rows, keys) for b in t.to_batches()), out)


def cells_inside(contours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y of the pixels whose centre lies inside by the even-odd rule, so contours within contours are holes."""
    order = Window.partitionBy(*keys, "row").orderBy("x")
    span = crossings(contours, keys).withColumns({"k": F.row_number().over(order), "stop": F.lead("x").over(order)}).where("k % 2 = 1 AND stop IS NOT NULL")
    first, last = F.ceil(F.col("x") - 0.5), F.ceil(F.col("stop") - 0.5) - 1
    return span.where(last >= first).select(*keys, F.explode(F.sequence(first, last)).alias("x"), F.col("row").alias("y"))


def coverage(cells: DataFrame, contours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tint, missed, extra, percent: cells (keys, x, y) against the inside of contours."""
    both = cells.select(*keys, "x", "y").distinct().withColumn("t", F.lit(1)).join(cells_inside(contours, keys).withColumn("i", F.lit(1)), [*keys, "x", "y"], "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    t, i = F.col("t").isNotNull(), F.col("i").isNotNull()
    out = both.groupBy(*keys).agg(n(t).alias("tint"), n(t & ~i).alias("missed"), n(~t & i).alias("extra"))
    return out.withColumn("percent", F.round((F.col("tint") - F.col("missed")) / F.greatest("tint", F.lit(1)) * 100, 1))
