"""Connected zones of page cells, labelled in tiles whose labels meet as a graph, and what is built on them.

``cells`` are rows of keys (a sheet), x, y (whole numbers from 0) and other columns; a cell that is not there is
background. A sheet may be of any size: tiles of ``tile`` by ``tile`` cells are labelled each on its own, the labels
that touch across an edge of tiles are united as components of a graph, and zones are summed from labels. No step
gathers a sheet.

A label is the least ``y * 2**31 + x`` of its cells, so it does not depend on the tiles. Cells that are given
twice count once, with their least other values; cells with a null or negative place are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.batches import ddl
from leafmill.operators.graph import components, cut, shuffled, united
from leafmill.operators.spatial import HINT, HOLE, area, inner_area, meeting

TILE = 512
#: Gray values of printed tint, and the shape and size rules of its zones.
TINT_LO, TINT_HI = 60, 220
CLOSE_RADIUS, CLOSE_TIMES = 12, 2
LEAST_ZONE, LEAST_SIDE = 16, 4
LEAST_HOLE, HOLE_OF_PAGE, HOLE_OF_ZONE = 2000, 0.0005, 0.5
RECT_COVERAGE = 0.95
#: Bits of x in a label.
X_BITS = 31


def _distinct(cells: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in cells.columns if c not in (*keys, "x", "y")]
    fit = cells.where("x >= 0 AND y >= 0")
    return fit.groupBy(*keys, "x", "y").agg(*(F.min(c).alias(c) for c in rest)) if rest else fit.select(*keys, "x", "y").distinct()


def roots(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each cell of a mask the flat place of the first cell of its component; -1 outside.

    Runs of a row are nodes; a run that touches one of the row above is united with it.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, start), stop = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first = np.searchsorted(row, np.arange(h + 1)).tolist()
    a, z, reach = start.tolist(), stop.tolist(), int(diagonal)
    for y in range(1, h):
        up, end = first[y - 1], first[y]
        for k in range(first[y], first[y + 1]):
            while up < end and z[up] + reach <= a[k]:
                up += 1
            at = up
            while at < end and a[at] < z[k] + reach:
                one, two = find(at), find(k)
                parent[max(one, two)] = min(one, two)
                at += 1
    out = np.full(h * w, -1, np.int64)
    top = np.array([find(k) for k in range(len(parent))], np.int64)
    if len(top):
        lengths = stop - start
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(row * w + start, lengths) + inside] = np.repeat((row * w + start)[top], lengths)
    return out.reshape(h, w)


def labelled(cells: DataFrame, keys: list[str], *, diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """``cells`` with ``zone``; cells that touch, by corners too if ``diagonal``, have one zone."""
    held = _distinct(cells, keys)
    tx, ty = F.floor(F.col("x") / tile).cast("long").alias("tx"), F.floor(F.col("y") / tile).cast("long").alias("ty")

    def own(rows: pa.Table) -> pa.Table:
        x, y = (rows.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        x0, y0 = x.min(), y.min()
        mask = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
        mask[y - y0, x - x0] = True
        at = roots(mask, diagonal)[y - y0, x - x0]
        return rows.append_column("part", pa.array(((at // mask.shape[1] + y0) << X_BITS) + at % mask.shape[1] + x0, pa.int64()))

    # The first cell of a part in its tile is its name until parts are united.
    parts = held.groupBy(*keys, tx, ty).applyInArrow(own, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", part long")
    near = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if diagonal else [])]
    first, last = (lambda c: F.pmod(F.col(c), F.lit(tile)) == 0), (lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1)
    rim = parts.where(first("x") | first("y") | last("x") | last("y")).select(*keys, "x", "y", "part")
    ahead = rim.select(*keys, F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in near))).alias("to"), F.col("part").alias("a"))
    edges = ahead.select(*keys, "to.x", "to.y", "a").join(shuffled(rim.withColumnRenamed("part", "b")), [*keys, "x", "y"]).where("a <> b").select(*keys, "a", "b").distinct()
    united = components(edges, keys)
    return shuffled(parts.join(shuffled(united.withColumnRenamed("node", "part")), [*keys, "part"], "left").withColumn("zone", F.coalesce("root", "part")).drop("part", "root"))


def measured(cells: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """keys, zone, n, and the box of each zone, x1 and y1 exclusive; ``more`` are aggregates besides."""
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")]
    return cells.groupBy(*keys, "zone").agg(F.count("*").alias("n"), *box, *more)


def reaching(cells: DataFrame, keys: list[str], strong: Column, *, tile: int = TILE) -> DataFrame:
    """Hysteresis: the cells whose zone has a cell that is ``strong``; weak ones grow from strong ones along touching cells."""
    marked = labelled(cells.withColumn("__s", ~F.coalesce(strong, F.lit(False))), keys, tile=tile)
    return marked.join(marked.where("NOT __s").select(*keys, "zone").distinct(), [*keys, "zone"], "left_semi").drop("__s")


def background(cells: DataFrame, sheets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y of the cells of each sheet (keys, w, h) that ``cells`` do not have."""
    rows = sheets.where("w > 0 AND h > 0").select(*keys, "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h").cast("long") - 1)).alias("y"))
    all_ = rows.select(*keys, "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w").cast("long") - 1)).alias("x"))
    return all_.join(cells.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct().transform(shuffled), [*keys, "x", "y"], "left_anti").select(*keys, "x", "y")


def holes(zoned: DataFrame, sheets: DataFrame, keys: list[str], *, tile: int = TILE) -> DataFrame:
    """keys, zone, hole, n, box: background that a zone of ``labelled`` cells encloses.

    Background touches by sides only where zones touch by corners. What reaches the sheet's frame is no hole; the
    cell left of a hole's first cell belongs to the zone around it.
    """
    empty = labelled(background(zoned, sheets, keys), keys, diagonal=False, tile=tile)
    m = measured(empty, keys).join(sheets.select(*keys, "w", "h"), keys).where("x0 > 0 AND y0 > 0 AND x1 < w AND y1 < h")
    at = m.select(*keys, F.col("zone").alias("hole"), "n", "x0", "y0", "x1", "y1", F.shiftright("zone", X_BITS).alias("y"), (F.col("zone").bitwiseAND((1 << X_BITS) - 1) - 1).alias("x"))
    return shuffled(at).join(zoned.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "zone"), [*keys, "x", "y"]).drop("x", "y")


def disc(radius: int) -> np.ndarray:
    """Offsets dx of each row of an ellipse-shaped structuring element, from -radius to radius."""
    dy = np.arange(-radius, radius + 1)
    return np.round(np.sqrt(np.maximum(radius * radius - dy * dy, 0))).astype(int)


def _grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation by ``disc``: sums of each row's window, then rows of the disc over each other."""
    h, w = mask.shape
    out, total = np.zeros_like(mask), np.pad(np.cumsum(mask, axis=1, dtype=np.int64), ((0, 0), (1, 0)))
    x = np.arange(w)
    for dy, reach in zip(range(-radius, radius + 1), disc(radius), strict=True):
        wide = total[:, np.minimum(x + reach + 1, w)] > total[:, np.maximum(x - reach, 0)]
        a, b = max(0, dy), min(h, h + dy)
        out[a:b] |= wide[a - dy : b - dy]
    return out


def _closed(mask: np.ndarray, radius: int, times: int) -> np.ndarray:
    for _ in range(times):
        mask = _grown(mask, radius)
    mask = ~mask
    for _ in range(times):
        mask = _grown(mask, radius)
    return ~mask


def _window(rows: pa.Table, tile: int, halo: int) -> tuple[int, int, np.ndarray]:
    """x and y of the first cell of a tile with what of its sheet is up to ``halo`` cells around it, and its mask."""
    w, h, tx, ty = (rows.column(c)[0].as_py() for c in ("w", "h", "tx", "ty"))
    x0, y0, x1, y1 = max(0, tx * tile - halo), max(0, ty * tile - halo), min(w, (tx + 1) * tile + halo), min(h, (ty + 1) * tile + halo)
    mask, there = np.zeros((y1 - y0, x1 - x0), bool), rows.filter(rows.column("x").is_valid()) if rows.column("x").null_count else rows
    mask[there.column("y").to_numpy() - y0, there.column("x").to_numpy() - x0] = True
    return x0, y0, mask


def _spread(cells: DataFrame, keys: list[str], tile: int, halo: int) -> DataFrame:
    """``cells`` with tx and ty of each tile of their sheet that they lie in or no more than ``halo`` away from."""
    n = lambda c, d: F.floor((F.col(c) + d) / tile).cast("int")
    last = lambda c, of: F.least(n(c, halo), F.floor((F.col(of) - 1) / tile).cast("int"))
    spread = cells.withColumn("tx", F.explode(F.sequence(F.greatest(n("x", -halo), F.lit(0)), last("x", "w"))))
    return spread.withColumn("ty", F.explode(F.sequence(F.greatest(n("y", -halo), F.lit(0)), last("y", "h"))))


def closed(cells: DataFrame, sheets: DataFrame, keys: list[str], *, radius: int = CLOSE_RADIUS, times: int = CLOSE_TIMES, tile: int = TILE) -> DataFrame:
    """keys, x, y after a closing: ``times`` dilations by a disc, then as many erosions; outside a sheet nothing erodes.

    A tile also gets the cells around it as far as the closing reaches, so tiles need no other exchange.
    """
    halo = 2 * radius * times
    if not radius or not times:
        return _distinct(cells.select(*keys, "x", "y"), keys)
    one = _distinct(cells.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")), keys).join(sheets.select(*keys, "w", "h"), keys).where("x < w AND y < h")
    spread = _spread(one, keys, tile, halo)
    columns = [c for c in spread.columns if c in keys]

    def close(rows: pa.Table) -> pa.Table:
        tx, ty = (rows.column(c)[0].as_py() for c in ("tx", "ty"))
        x0, y0, mask = _window(rows, tile, halo)
        y, x = np.nonzero(_closed(mask, radius, times))
        own = (x + x0 >= tx * tile) & (x + x0 < (tx + 1) * tile) & (y + y0 >= ty * tile) & (y + y0 < (ty + 1) * tile)
        return pa.table({c: pa.repeat(rows.column(c)[0], int(own.sum())) for c in columns} | {"x": pa.array(x[own] + x0, pa.int64()), "y": pa.array(y[own] + y0, pa.int64())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.select(*columns).schema)
    return spread.groupBy(*keys, "tx", "ty").applyInArrow(close, f"{schema}, x long, y long").select(*keys, "x", "y")


def outside_boxes(cells: DataFrame, boxes: DataFrame, keys: list[str], *, cell: int = 64) -> DataFrame:
    """``cells`` that lie in no box (keys, x0, y0, x1, y1; x1 and y1 exclusive); a box and a cell meet in the grid cell of the cell."""
    whole = boxes.select(*keys, *(F.floor(F.least(a, b)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"))), *(F.ceil(F.greatest(a, b)).alias(b) for a, b in (("x0", "x1"), ("y0", "y1")))).where("x1 > x0 AND y1 > y0 AND x1 > 0 AND y1 > 0")
    at = lambda c, d=0: F.floor((F.col(c) - d) / cell).cast("long")
    span = lambda a, b: F.explode(F.sequence(F.greatest(at(a), F.lit(0)), F.greatest(at(b, 1), F.lit(0))))
    grid = whole.withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1")).alias("b")
    placed = cells.withColumn("gx", at("x")).withColumn("gy", at("y")).alias("c")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col(f"b.{k}") == F.col(f"c.{k}") for k in ("gx", "gy")]
    inside = (F.col("c.x") >= F.col("b.x0")) & (F.col("c.x") < F.col("b.x1")) & (F.col("c.y") >= F.col("b.y0")) & (F.col("c.y") < F.col("b.y1"))
    for s in same:
        inside = inside & s
    return placed.join(grid, inside, "left_anti").drop("gx", "gy")


def _pieces(rows: pa.Table, keys: list[str], radius: int, times: int, tile: int) -> pa.Table:
    """Of one tile, after a closing: the parts of its cells and of its background (``empty``) with size, box and, for background, the
    part left of its first cell, null where that lies in another tile; with ``rim`` the cells beside other tiles, of one cell each."""
    halo, (w, h, tx, ty) = 2 * radius * times, (rows.column(c)[0].as_py() for c in ("w", "h", "tx", "ty"))
    x0, y0, mask = _window(rows, tile, halo)
    if halo and mask.any():
        mask = _closed(mask, radius, times)
    left, top = tx * tile, ty * tile
    mask = mask[top - y0 : min(h, top + tile) - y0, left - x0 : min(w, left + tile) - x0]
    across = mask.shape[1]
    name = lambda at: ((at // across + top) << X_BITS) + at % across + left
    found, before = [], None
    for empty, own in ((False, mask), (True, ~mask)):
        at = roots(own, not empty)
        y, x = np.nonzero(own)
        first, part, n = np.unique(at[own], return_inverse=True, return_counts=True)
        box = [np.full(len(first), v, np.int64) for v in (across, tile, 0, 0)]
        for bound, least, value in zip(box, (True, True, False, False), (x, y, x + 1, y + 1), strict=True):
            (np.minimum if least else np.maximum).at(bound, part, value)
        held = np.full(len(first), -1, np.int64)
        if empty:
            inner = np.flatnonzero(first % across > 0)
            held[inner] = name(before.ravel()[first[inner] - 1])
        before = at
        gx, gy = x + left, y + top
        rim = ((x == 0) & (gx > 0)) | ((x == tile - 1) & (gx < w - 1)) | ((y == 0) & (gy > 0)) | ((y == tile - 1) & (gy < h - 1))
        zero = np.zeros(rim.sum(), np.int64)
        found.append([np.full(len(first) + len(zero), empty), np.repeat([False, True], [len(first), len(zero)]), *map(np.concatenate, zip(
            [name(first), n, box[0] + left, box[1] + top, box[2] + left, box[3] + top, held],
            [name(at[own][rim]), zero + 1, gx[rim], gy[rim], gx[rim] + 1, gy[rim] + 1, zero - 1], strict=True))])
    empty, rim, part, n, *box, held = map(np.concatenate, zip(*found, strict=True))
    out = {k: pa.repeat(rows.column(k)[0], len(part)) for k in keys} | {"empty": pa.array(empty), "rim": pa.array(rim)}
    out |= {c: pa.array(v.astype(np.int64)) for c, v in zip(("part", "n", "x0", "y0", "x1", "y1"), (part, n, *box), strict=True)}
    return pa.table(out | {"beside": pa.array(held, mask=held < 0)})


def closed_zones(cells: DataFrame, sheets: DataFrame, keys: list[str], *, radius: int = CLOSE_RADIUS, times: int = CLOSE_TIMES, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """``measured`` zones and ``holes`` of ``closed`` cells, without the cells between: a tile is closed and labelled at once,
    and what goes on from it are its parts and the cells beside other tiles."""
    fit = sheets.where("w > 0 AND h > 0").select(*keys, F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"))
    one = cells.where("x >= 0 AND y >= 0").select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).join(fit, keys).where("x < w AND y < h")
    spread = _spread(one, keys, tile, 2 * radius * times)
    whole = fit
    for t, of in (("tx", "w"), ("ty", "h")):
        whole = whole.withColumn(t, F.explode(F.sequence(F.lit(0), F.floor((F.col(of) - 1) / tile).cast("int"))))
    # A tile without cells is background.
    tiles = spread.unionByName(whole.withColumns({"x": F.lit(None).cast("long"), "y": F.lit(None).cast("long")}))
    schema = f"{ddl(fit.select(*keys))}, empty boolean, rim boolean, part long, n long, x0 long, y0 long, x1 long, y1 long, beside long"
    pieces = cut(tiles.groupBy(*keys, "tx", "ty").applyInArrow(lambda rows: _pieces(rows, keys, radius, times, tile), schema))
    kind, rim = [*keys, "empty"], pieces.where("rim").select(*keys, "empty", F.col("x0").alias("x"), F.col("y0").alias("y"), "part")
    # Background touches by sides only.
    near = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(bool(dx and dy)).alias("corner")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))))
    ahead = rim.select(*kind, F.explode(near).alias("to"), F.col("part").alias("a")).where("NOT (empty AND to.corner)")
    edges = ahead.select(*kind, "to.x", "to.y", "a").join(shuffled(rim.withColumnRenamed("part", "b")), [*kind, "x", "y"]).where("a <> b")
    same = united(edges, kind).withColumnRenamed("node", "part")
    parts = pieces.where("NOT rim").drop("rim").join(shuffled(same), [*kind, "part"], "left").withColumn("zone", F.coalesce("root", "part"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    zoned = cut(parts.groupBy(*kind, "zone").agg(F.sum("n").alias("n"), *box, F.max(F.when(F.col("part") == F.col("zone"), F.col("beside"))).alias("beside")))
    size = zoned.where("NOT empty").drop("empty", "beside")
    # A zone that reaches the sheet's frame is no hole; the cell left of a hole's first one belongs to the zone around it.
    inner = zoned.where("empty").drop("empty").join(fit, keys).where("x0 > 0 AND y0 > 0 AND x1 < w AND y1 < h").withColumnRenamed("zone", "hole")
    inner = inner.withColumns({"y": F.shiftright("hole", X_BITS), "x": F.col("hole").bitwiseAND((1 << X_BITS) - 1) - 1}).drop("w", "h")
    there = rim.where("NOT empty").select(*keys, "x", "y", F.col("part").alias("other"))
    inner = inner.join(shuffled(there), [*keys, "x", "y"], "left").withColumn("part", F.coalesce("beside", "other"))
    around = shuffled(same.where("NOT empty").drop("empty"))
    gaps = inner.join(around, [*keys, "part"], "left").withColumn("zone", F.coalesce("root", "part"))
    return size, cut(gaps.select(*keys, "zone", "hole", "n", "x0", "y0", "x1", "y1"))


def tint_zones(cells: DataFrame, sheets: DataFrame, hints: DataFrame, texts: DataFrame, keys: list[str], *, radius: int = CLOSE_RADIUS, times: int = CLOSE_TIMES, tile: int = TILE) -> DataFrame:
    """keys, zone, pos, shape, n, holes, hole_area, box: printed tint of each sheet.

    Cells (keys, x, y, gray) within the tint's range and outside ``texts`` are closed over text strokes and labelled.
    A zone counts if a hint box (keys, pos, box) shares HINT of the smaller of the two boxes. A hole is one
    if it has HOLE_OF_ZONE of the filled zone and is large or shares HOLE of the smaller area with a text. A
    zone is a ``frame`` with holes, a ``rect`` if it fills its box, else a ``poly``. A hint that no zone takes is a
    ``rect`` of its own, with its ``pos`` and a null zone.
    """
    tint = outside_boxes(cells.where((F.col("gray") >= TINT_LO) & (F.col("gray") <= TINT_HI)), texts, keys)
    zoned, gaps = map(shuffled, closed_zones(tint, sheets, keys, radius=radius, times=times, tile=tile))
    filled = shuffled(gaps.groupBy(*keys, "zone").agg(F.sum("n").alias("gaps")))
    size = shuffled(zoned.join(filled, [*keys, "zone"], "left").withColumn("whole", F.col("n") + F.coalesce("gaps", F.lit(0))).where(F.col("whole") >= LEAST_ZONE))
    boxes = lambda df, *rest: df.select(*keys, *rest, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    both = meeting(boxes(size, "zone"), boxes(hints, "pos"), keys, cell=256.0)
    hit = both.where(inner_area(F.col("a"), F.col("b")) / F.greatest(F.least(area(F.col("a")), area(F.col("b"))), F.lit(1.0)) >= HINT).where(inner_area(F.col("a"), F.col("b")) > 0)
    hit = shuffled(hit.select(*keys, F.col("a.zone").alias("zone"), F.col("b.pos").alias("pos")))
    wanted = shuffled(size.join(hit.select(*keys, "zone").distinct(), [*keys, "zone"], "left_semi"))
    near = meeting(boxes(gaps, "hole"), boxes(texts.withColumn("pos", F.lit(0)), "pos"), keys, cell=256.0)
    texted = near.where(inner_area(F.col("a"), F.col("b")) / F.greatest(F.least(area(F.col("a")), area(F.col("b"))), F.lit(1.0)) >= HOLE).select(*keys, F.col("a.hole").alias("hole")).distinct().withColumn("texted", F.lit(True)).transform(shuffled)
    large = F.greatest(F.lit(LEAST_HOLE), F.floor(F.col("w") * F.col("h") * HOLE_OF_PAGE))
    real = gaps.join(wanted.select(*keys, "zone", "whole"), [*keys, "zone"]).join(sheets.select(*keys, "w", "h"), keys).join(texted, [*keys, "hole"], "left")
    real = real.where((F.col("n") >= HOLE_OF_ZONE * F.col("whole")) & ((F.col("n") >= large) | F.col("texted")))
    cavities = shuffled(real.groupBy(*keys, "zone").agg(F.count("*").alias("holes"), F.sum("n").alias("hole_area")))
    shape = F.when(F.col("holes") > 0, "frame").when(F.col("n") >= RECT_COVERAGE * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), "rect").otherwise("poly")
    found = wanted.join(cavities, [*keys, "zone"], "left").fillna(0, ["holes", "hole_area"]).where(f"x1 - x0 >= {LEAST_SIDE} AND y1 - y0 >= {LEAST_SIDE}")
    box = ["x0", "y0", "x1", "y1"]
    found = found.select(*keys, "zone", F.lit(None).cast(hints.schema["pos"].dataType).alias("pos"), shape.alias("shape"), "n", "holes", "hole_area", *box)
    rest = hints.join(hit.select(*keys, "pos").distinct(), [*keys, "pos"], "left_anti").join(sheets.select(*keys, "w", "h"), keys)
    fit = lambda c, of: F.greatest(F.lit(0), F.least(F.col(of), F.col(c))).cast("long").alias(c)
    rest = rest.select(*keys, F.lit(None).cast("long").alias("zone"), "pos", F.lit("rect").alias("shape"), fit("x0", "w"), fit("y0", "h"), fit("x1", "w"), fit("y1", "h"))
    rest = rest.where(f"x1 - x0 >= {LEAST_SIDE} AND y1 - y0 >= {LEAST_SIDE}").withColumns({"n": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), "holes": F.lit(0).cast("long"), "hole_area": F.lit(0).cast("long")})
    return found.unionByName(rest)
