"""Page-number resolution in full: band, votes, position model and the passes that assign a number a page.

``pages`` has doc, i (place in the book), page_index, page_w, page_h, one row a page; ``cands`` has doc, i,
ord (order on the page), band, kind, v (null: unparsed), text and a box. All steps are aggregations and
windows on the book or its pages, so books spread over tasks; a book's rows are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import numerals
from leafmill.operators.candidates import BOX
from leafmill.operators.graph import cut
from leafmill.operators.sequence import gaps

LEAST_VOTES, VOTE_SHARE, OVERRUN = 3, 0.3, 50
LEAST_ANCHORS, POSITION_K, FLOOR_X, FLOOR_Y, WIDEST, SIDES_APART = 8, 4.0, 0.03, 0.02, 0.15, 0.25
MAD_SCALE, LIKE_ENOUGH = 1.4826, 0.7
GAP_FLAG = "page_number_gap"


def chosen_band(cands: DataFrame) -> DataFrame:
    """doc, band, pages_top, pages_bottom: the band with candidates on more pages, bottom if equal."""
    on = lambda b: F.countDistinct(F.when(F.col("band") == b, F.col("i")))
    each = cands.groupBy("doc").agg(on("top").alias("pages_top"), on("bottom").alias("pages_bottom"))
    return each.where("pages_top + pages_bottom > 0").select("doc", F.when(F.col("pages_bottom") >= F.col("pages_top"), "bottom").otherwise("top").alias("band"), "pages_top", "pages_bottom")


def in_band(pages: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates of their book's band with page columns, centre fractions fx, fy and their offset.

    Numbers beyond the book's pages and OVERRUN more have ``beyond`` set and no offset.
    """
    size = pages.groupBy("doc").agg((F.count("*") + OVERRUN).alias("most"))
    held = cands.join(chosen_band(cands).select("doc", "band"), ["doc", "band"]).join(size, "doc").join(pages.select("doc", "i", "page_index", "page_w", "page_h"), ["doc", "i"])
    beyond = F.coalesce(F.col("v") > F.col("most"), F.lit(False))
    return held.withColumns({
        "fx": (F.col("x0") + F.col("x1")) / 2 / F.col("page_w"), "fy": (F.col("y0") + F.col("y1")) / 2 / F.col("page_h"), "parity": F.pmod("page_index", F.lit(2)),
        "beyond": beyond, "off": F.when(~beyond, F.col("v") - F.col("i")),
    })


def voted(band: DataFrame) -> DataFrame:
    """``band`` with votes (of the candidate's kind and offset), top (most votes of the kind) and d_kind, d_off.

    Candidates vote, not pages. The dominant offset of a book has the most votes, LEAST_VOTES at least; then
    the least distance, kind and offset decide. One partitioning by book serves all windows.
    """
    book = Window.partitionBy("doc")
    held = F.col("off").isNotNull()
    each = band.withColumn("votes", F.when(held, F.count("off").over(Window.partitionBy("doc", "kind", "off"))))
    each = each.withColumn("top", F.max("votes").over(Window.partitionBy("doc", "kind")))
    rank = F.when(F.col("votes") >= LEAST_VOTES, F.struct((-F.col("votes")).alias("v"), F.abs("off").alias("a"), "kind", "off"))
    return each.withColumn("__d", F.min(rank).over(book)).withColumns({"d_kind": F.col("__d.kind"), "d_off": F.col("__d.off")}).drop("__d")


def anchors(band: DataFrame) -> DataFrame:
    """doc, i, parity, fx, fy of the first candidate of each page in the dominant offset; ``band`` is ``voted``."""
    held = band.where((F.col("kind") == F.col("d_kind")) & (F.col("off") == F.col("d_off")))
    first = Window.partitionBy("doc", "i").orderBy("ord")
    return held.withColumn("__r", F.row_number().over(first)).where("__r = 1").select("doc", "i", "parity", "fx", "fy")


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _mids(points: Column) -> Column:
    return F.struct(_median(F.transform(points, lambda p: p["fx"])).alias("mx"), _median(F.transform(points, lambda p: p["fy"])).alias("my"))


def _spread(points: Column, mids: Column) -> Column:
    """struct(mx, my, sx, sy, n): medians and scaled median deviations of an array of points."""
    off = lambda c: MAD_SCALE * _median(F.transform(points, lambda p: F.abs(p[f"f{c}"] - mids[f"m{c}"])))
    return F.struct(mids["mx"].alias("mx"), mids["my"].alias("my"), off("x").alias("sx"), off("y").alias("sy"), F.size(points).alias("n"))


def _near(fx: Column, fy: Column, s: Column) -> Column:
    return (F.abs(fx - s["mx"]) <= F.greatest(POSITION_K * s["sx"], F.lit(FLOOR_X))) & (F.abs(fy - s["my"]) <= F.greatest(POSITION_K * s["sy"], F.lit(FLOOR_Y)))


def inside(mx: Column, sx: Column, my: Column, sy: Column) -> Column:
    return (F.abs(F.col("fx") - mx) <= F.greatest(POSITION_K * sx, F.lit(FLOOR_X))) & (F.abs(F.col("fy") - my) <= F.greatest(POSITION_K * sy, F.lit(FLOOR_Y)))


def position_model(points: DataFrame) -> DataFrame:
    """doc, parity, x_mode, mx, sx, my, sy: where a number stands on each parity; no row without a model.

    Estimates drop outliers once. Both parities have their own if each has LEAST_ANCHORS anchors, else the
    book has one; x is the book's too unless the parities' x lie SIDES_APART apart. Fewer anchors after the
    outliers went, or a spread over WIDEST, leave the book without a model. A book's anchors, one a page at most,
    are one array.
    """
    out = points.groupBy("doc").agg(F.collect_list(F.struct("parity", "fx", "fy")).alias("all")).where(F.size("all") >= LEAST_ANCHORS)
    of = lambda p: F.filter("all", lambda x: x["parity"] == p)
    out = out.withColumns({"p0": of(0), "p1": of(1)})
    out = out.withColumn("both", F.least(F.size("p0"), F.size("p1")) >= LEAST_ANCHORS)

    def kept(df: DataFrame, points: str, name: str) -> DataFrame:
        """``df`` with ``name``, the points inside the first estimate, and ``name``_s, the estimate of those."""
        df = df.withColumn("__m", _mids(F.col(points)))
        df = df.withColumn("__s", _spread(F.col(points), F.col("__m")))
        df = df.withColumn(name, F.filter(points, lambda p: _near(p["fx"], p["fy"], F.col("__s"))))
        df = df.withColumn("__m", _mids(F.col(name)))
        return df.withColumn(f"{name}_s", _spread(F.col(name), F.col("__m"))).drop("__m", "__s")

    for source, name in (("all", "ka"), ("p0", "k0"), ("p1", "k1")):
        out = kept(out, source, name)
    out = kept(out.withColumn("pooled", F.concat("k0", "k1")), "pooled", "kp")
    ok = lambda s: F.coalesce((F.col(f"{s}.n") >= LEAST_ANCHORS) & (F.greatest(f"{s}.sx", f"{s}.sy") <= WIDEST), F.lit(False))
    apart = F.abs(F.col("k0_s.mx") - F.col("k1_s.mx")) > SIDES_APART
    row = lambda parity, mode, x, y: F.struct(F.lit(parity).alias("parity"), F.lit(mode).alias("x_mode"), F.col(f"{x}.mx").alias("mx"), F.col(f"{x}.sx").alias("sx"), F.col(f"{y}.my").alias("my"), F.col(f"{y}.sy").alias("sy"))
    two = lambda mode, x0, x1, y0, y1: F.array(row(0, mode, x0, y0), row(1, mode, x1, y1))
    model = (
        F.when(~F.col("both"), F.when(ok("ka_s"), two("pooled", "ka_s", "ka_s", "ka_s", "ka_s")))
        .when(ok("k0_s") & ok("k1_s"), F.when(apart, two("parity", "k0_s", "k1_s", "k0_s", "k1_s")).when(ok("kp_s"), two("pooled", "kp_s", "kp_s", "k0_s", "k1_s")))
    )
    return out.select("doc", F.explode(model).alias("m")).select("doc", "m.*")


def resolve(pages: DataFrame, cands: DataFrame) -> DataFrame:
    """doc, i, page_index, number, kind, text, pass, box of every page; books without a supported offset keep none.

    pass: fallback (no position model: the candidate with the most supported votes), primary, bracketed (a
    misread between pages of the dominant offset), rescued (an unparsed text like the expected number),
    place (a box where numbers stand, without a number) or null. Each page's best candidate of every pass comes
    from one aggregation; the first pass that has one decides.
    """
    band = cut(voted(in_band(pages, cands)).where("d_off is not null"))
    model = position_model(anchors(band))
    modelled = model.select("doc").distinct().withColumn("modelled", F.lit(True))
    band = band.join(model, ["doc", "parity"], "left").join(modelled, "doc", "left")
    place = F.coalesce(inside(*map(F.col, ("mx", "sx", "my", "sy"))), F.lit(False))
    expected = F.col("i") + F.col("d_off")
    band = band.withColumn("place", place)
    odd = band.where(F.col("place") & F.col("v").isNull() & (expected > 0) & numerals.may_be_like(expected.cast("string"), F.col("text"), LIKE_ENOUGH))
    like = odd.select("doc", "i", "ord", numerals.likeness(expected.cast("string"), F.col("text")).alias("like"))
    band = band.join(like.groupBy("doc", "i", "ord").agg(F.max("like").alias("like")), ["doc", "i", "ord"], "left")

    most = F.col("votes")
    of_dominant = F.col("kind") == F.col("d_kind")
    found = {
        "fallback": (F.col("modelled").isNull() & (most >= LEAST_VOTES), (-most, F.col("ord"))),
        "primary": (F.col("place") & (most >= F.greatest(F.lit(float(LEAST_VOTES)), VOTE_SHARE * F.col("top"))), (-most, F.col("ord"))),
        "bracketed": (F.col("place") & ~F.col("beyond") & of_dominant, (F.col("ord"), F.lit(0))),
        "rescued": (F.col("like") >= LIKE_ENOUGH, (-F.col("like"), F.col("ord"))),
        "place": (F.col("place"), (F.col("beyond").cast("int"), F.col("ord"))),
    }
    it = F.struct(F.col("v").alias("number"), "kind", "text", F.struct(*BOX).alias("box"), (of_dominant & (F.col("off") == F.col("d_off"))).alias("dominant"))
    best = [F.min_by(F.when(ok, it), F.when(ok, F.struct(*(c.alias(f"k{n}") for n, c in enumerate(order))))).alias(name) for name, (ok, order) in found.items()]
    page = band.groupBy("doc", "i").agg(F.first("d_kind").alias("d_kind"), F.first("d_off").alias("d_off"), *best)
    book = Window.partitionBy("doc")
    dominant = F.when(F.col("primary.dominant"), F.col("i"))
    page = page.withColumns({"from_i": F.min(dominant).over(book), "to_i": F.max(dominant).over(book)})

    none = F.lit(None).cast("string")
    taken = lambda p, number, kind, text, name: F.struct(number.cast("long").alias("number"), kind.alias("kind"), text.alias("text"), F.col(f"{p}.box").alias("box"), F.lit(name).alias("pass"))
    own = lambda p: taken(p, F.col(f"{p}.number"), F.col(f"{p}.kind"), F.col(f"{p}.text"), p)
    between = (F.col("i") > F.col("from_i")) & (F.col("i") < F.col("to_i"))
    result = (
        F.when(F.col("fallback").isNotNull(), own("fallback"))
        .when(F.col("primary").isNotNull(), own("primary"))
        .when(F.col("bracketed").isNotNull() & between, taken("bracketed", expected, F.col("d_kind"), F.col("bracketed.text"), "bracketed"))
        .when(F.col("rescued").isNotNull(), taken("rescued", expected, F.col("d_kind"), F.col("rescued.text"), "rescued"))
        .when(F.col("place").isNotNull(), taken("place", F.lit(None), none, none, "place"))
    )
    return pages.select("doc", "i", "page_index").join(page.select("doc", "i", result.alias("r")), ["doc", "i"], "left").select("doc", "i", "page_index", "r.number", "r.kind", "r.text", "r.pass", "r.box")


def gap_warnings(resolved: DataFrame) -> DataFrame:
    """doc, kind, page_index, prev_value, number, missing, message: numbers that jump further than the pages do."""
    out = gaps(resolved.where("number is not null").select("doc", "kind", "page_index", "number"), ["doc", "kind"], "page_index", "number")
    return out.where("missing > 1").withColumn("message", F.format_string("p%d: page number %d -> %d (~%d page(s) may be missing)", "page_index", "prev_value", "number", "missing"))


def with_gap_flags(pages: DataFrame, warnings: DataFrame) -> DataFrame:
    """``pages`` (doc, page_index, flags) with the gap flag on exactly the pages that ``warnings`` name."""
    marked = warnings.select("doc", "page_index").distinct().withColumn("__gap", F.lit(True))
    cleared = F.array_remove(F.coalesce("flags", F.array().cast("array<string>")), GAP_FLAG)
    flags = F.when(F.col("__gap"), F.array_append(cleared, F.lit(GAP_FLAG))).otherwise(cleared)
    return pages.join(marked, ["doc", "page_index"], "left").withColumn("flags", flags).drop("__gap")
