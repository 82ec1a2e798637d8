"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Of all rates r with sum(size * r) = target for each source, the ones nearest to taking everything once
(least relative entropy, each document weighed by its tokens) are exponential: r = exp(lambda_s + mu * z),
one dual variable a source and one, ``mu``, that couples all of them. z is the document's log2 size less
the corpus' mean over tokens: the mix would otherwise drift to the lengths of the sources it favours.
Sources hold exactly; the lengths as far as a ridge of RIDGE of all tokens lets ``mu`` go, so a solution
always exists. No rate is above ``cap``.

The dual is convex and solved by Newton steps. Documents are summed by source and size once, map-side
first; a step is one distributed sum over that table (gradient, Hessian, its border for ``mu``), from
which every source works out its own step and the driver gets one row. Sums are of integers, so
reruns give the same bits whatever the order of tasks.

Rates become copies by systematic rounding: within a source, documents stand in order of size class,
hash bucket, size and hash, and each gets the integers that the running sum of the rates passes at it.
Neighbours are alike in size, so their rounding errors cancel; a last repair flips the documents that
bring a source nearest to its target. Running sums are taken in two levels (bucket, then offsets of
buckets), and a size class has as many buckets as its rows need, so no source has to fit a task.

Defined cases: null or empty text has size 0 and takes 0; the null source is a source of its own;
repeated rows count and are taken one by one; a source without tokens has target 0; an empty table
gives an empty result; a very long text is one document like others; other columns play no part,
whatever their names. Targets are worked out on one row a source, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
RIDGE = 0.5
#: Newton stops at this relative error of every source's tokens, or after STEPS; no step changes a rate by more than e**LONGEST.
TOLERANCE, STEPS, LONGEST = 1e-6, 40, 1.0
#: Rows of a bucket, about; units that stand for a rate of 1; fixed-point units of a token in the sums of a step.
BUCKET_ROWS, UNITS, FIXED = 50_000, 1 << 20, 1 << 10
REPAIRS = 3


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of runs of non-blank characters of the whole text."""
    size = F.coalesce(F.regexp_count("text", F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes dealt by weight, none above ``cap`` times its size.

    A source stops at its cap if its size over its weight is below the common level L, the rest get
    L * weight. L is found by one pass over the sources in order of size over weight: the first
    k of them stop, and the first k is right whose level lies under the next one's bound: levels rise up
    to it and fall after it.
    Works on one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    by_bound = Window.partitionBy(F.lit(0)).orderBy("bound", F.col("source").asc_nulls_last())
    so_far, rest = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    return (
        total.withColumn("weight", weight.cast("double"))
        .withColumn("bound", cap * F.col("source_size") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(every))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap * F.col("source_size")).over(so_far), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("bound"), F.col("level"))).over(every))
        .withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), cap * F.col("source_size")), cap * F.col("source_size")))
        .select("source", "source_size", F.col("target").cast("double").alias("target"))
    )


def key_of(source: str = "source") -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def entropy_balance(groups: DataFrame, targets: DataFrame, *, cap: float = CAP, ridge: float = RIDGE) -> tuple[DataFrame, float]:
    """(key, lambda) and mu for ``groups`` (key, z, tokens) and ``targets`` (key, source_size, target).

    A target of 0 has no finite dual and the rate 0, a target at the cap the rate ``cap``: lambda is
    null for the one and infinite for the other, and Newton leaves both as they are. A step that does not
    lower the dual is halved until it does.
    """
    size, t = F.col("source_size"), F.col("target")
    at_cap = t >= cap * size * (1 - 1e-12)
    start = F.when(t <= 0, F.lit(None)).when(at_cap, F.lit(float("inf"))).otherwise(F.log(t / size))
    state = materialise(targets.where("source_size > 0").select("key", "target", start.cast("double").alias("lambda")), "dual")
    total = groups.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return state.select("key", "lambda"), 0.0
    fixed = lambda x: F.coalesce(F.sum(F.round(x * FIXED).cast("long")), F.lit(0)) / FIXED
    z, tokens, top = F.col("z"), F.col("tokens"), F.log(F.lit(cap))
    mu, move, scale, lowest = 0.0, None, 1.0, None
    for _ in range(STEPS):
        open_ = F.col("lambda") < float("inf")  # null: not open either
        tilt = F.col("lambda") + mu * z
        rate = F.when(F.col("lambda").isNull(), 0.0).otherwise(F.when(tilt < top, F.exp(tilt)).otherwise(cap))
        # The dual of a rate that stops at the cap goes on as a straight line.
        dual = F.when(F.col("lambda").isNull(), 0.0).when(open_, F.when(tilt < top, F.exp(tilt)).otherwise(cap + cap * (tilt - top))).otherwise(cap * mu * z)
        held = groups.join(state, "key").withColumns({"got": tokens * rate, "free": F.when(open_ & (tilt < top), tokens * rate).otherwise(0.0), "dual": tokens * dual})
        each = held.groupBy("key").agg(
            F.first("lambda").alias("lambda"), F.first("target").alias("target"), fixed(F.col("got")).alias("got"), fixed(F.col("free")).alias("h"),
            fixed(F.col("free") * z).alias("b"), fixed(F.col("got") * z).alias("m"), fixed(F.col("free") * z * z).alias("hm"), fixed(F.col("dual")).alias("dual"),
        )
        each = each.withColumn("open", F.coalesce(open_, F.lit(False))).withColumn("g", F.when(F.col("open"), F.col("got") - F.col("target")).otherwise(0.0))
        each = materialise(each.withColumn("h", F.greatest("h", F.lit(1.0 / FIXED))), "step")
        part = lambda x: fixed(F.when(F.col("open"), x))
        s = each.agg(
            fixed(F.col("m")).alias("m"), part(F.col("hm")).alias("hm"), part(F.col("b") * F.col("g") / F.col("h")).alias("bg"), part(F.col("b") * F.col("b") / F.col("h")).alias("bb"),
            (fixed(F.col("dual")) - part(F.col("lambda") * F.col("target"))).alias("dual"), F.max(F.abs("g") / F.col("target")).alias("off"),
        ).first()
        value = s["dual"] + ridge * total * mu * mu / 2
        slope = s["m"] + ridge * total * mu
        if max(s["off"] or 0.0, abs(slope) / total) < TOLERANCE:
            break
        # Sums of rounded terms leave a little noise in the dual.
        if lowest is not None and value > lowest + 1e-7 * total and scale > 2**-20:
            scale /= 2
        else:
            lowest, scale = value, 1.0
            step_mu = -(slope - s["bg"]) / max(s["hm"] + ridge * total - s["bb"], ridge * total)
            step_mu = max(-LONGEST, min(LONGEST, step_mu))
            longest = F.lit(LONGEST)
            step = F.when(F.col("open"), F.greatest(-longest, F.least(longest, -(F.col("g") + F.col("b") * step_mu) / F.col("h")))).otherwise(0.0)
            move = each.select("key", "target", "lambda", step.alias("move")), mu, step_mu
        moves, mu_at, mu_step = move
        mu = mu_at + scale * mu_step
        state = moves.select("key", "target", (F.col("lambda") + scale * F.col("move")).alias("lambda"))
    return state.select("key", "lambda"), mu


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, ridge: float = RIDGE) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate, source of every row of ``docs``."""
    return mix_sizes(materialise(sized(docs), "sizes"), weights=weights, share=share, cap=cap, ridge=ridge)


def rates(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, ridge: float = RIDGE) -> tuple[DataFrame, DataFrame]:
    """Per source key, source_size, target, lambda, mu, mean (of log2 size over tokens); and rows a size class."""
    per_source = materialise(source_targets(sizes, weights=weights, share=share, cap=cap).withColumn("key", key_of()), "targets")
    counted = sizes.where("size > 0").groupBy(key_of().alias("key"), "size").agg(F.count("*").alias("rows"))
    counted = materialise(counted.select("key", "size", "rows", (F.col("rows") * F.col("size")).alias("tokens"), F.log2(F.col("size").cast("double")).alias("length")), "groups")
    whole = counted.agg(F.sum(F.round(F.col("tokens") * F.col("length") * FIXED).cast("long")).alias("l"), F.sum("tokens").alias("n")).first()
    mean = whole["l"] / FIXED / whole["n"] if whole["n"] else 0.0
    dual, mu = entropy_balance(counted.select("key", (F.col("length") - mean).alias("z"), "tokens"), per_source.select("key", "source_size", "target"), cap=cap, ridge=ridge)
    solved = per_source.join(dual, "key", "left").select("key", "source_size", "target", "lambda", F.lit(mu).alias("mu"), F.lit(mean).alias("mean"))
    classes = counted.groupBy("key", _size_class().alias("class")).agg(F.sum("rows").alias("rows"))
    return materialise(solved, "rates"), materialise(classes, "classes")


def _size_class() -> Column:
    return F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int")


def mix_sizes(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, ridge: float = RIDGE) -> DataFrame:
    solved, classes = rates(sizes, weights=weights, share=share, cap=cap, ridge=ridge)
    raised = F.exp(F.col("lambda") + F.col("mu") * (F.log2(F.col("size").cast("double")) - F.col("mean")))
    rate = F.coalesce(F.least(raised, F.lit(cap)), F.lit(0.0))
    parts = classes.select("key", "class", (F.floor(F.col("rows") / BUCKET_ROWS) + 1).alias("parts"))
    keyed = sizes.where("size > 0").withColumns({"key": key_of(), "class": _size_class()}).join(parts, ["key", "class"]).join(solved, "key")
    keyed = keyed.select(
        "doc_id", "source", "key", "size", "source_size", "target", "class", F.pmod(F.xxhash64("doc_id", "size"), F.col("parts")).cast("int").alias("salt"),
        rate.alias("rate"), F.floor(rate * UNITS).cast("long").alias("units"),
    )
    group = ["key", "class", "salt"]
    sums = keyed.groupBy(*group).agg(F.sum("units").alias("units"))
    before = Window.partitionBy("key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, F.coalesce(F.sum("units").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*group).orderBy("size", F.xxhash64("doc_id"), "doc_id")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumns({"k": F.row_number().over(within), "upto": F.sum("units").over(upto)}).join(offsets, group)
    passed = lambda at: F.floor((at + UNITS // 2) / UNITS)
    place = F.col("offset") + F.col("upto")
    copies = F.least(passed(place) - passed(place - F.col("units")), F.lit(int(cap))).cast("int")
    taken = materialise(placed.select("doc_id", "source", *group, "k", "size", "source_size", "target", "rate", copies.alias("copies")), "copies")
    flips = None
    for _ in range(REPAIRS):
        now = taken if flips is None else _flipped(taken, flips)
        gap = now.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        change = F.when((F.col("gap") > 0) & (F.col("copies") < int(cap)), 1).when((F.col("gap") < 0) & (F.col("copies") > 0), -1)
        one = (
            now.join(gap, "key")
            .withColumn("change", change)
            .withColumn("left", F.abs(F.col("gap") - F.col("change") * F.col("size")))
            .where("left < abs(gap)")
            .groupBy("key")
            .agg(F.min(F.struct("left", "class", "salt", "k", "change")).alias("best"))
            .select("key", "best.class", "best.salt", "best.k", "best.change")
        )
        one = materialise(one, "flips")
        flips = one if flips is None else flips.unionByName(one)
    out = ["doc_id", "size", "source_size", "target", "taken", "copies", "rate", "source"]
    done = _flipped(taken, flips).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).select(*out)
    empty = sizes.where("size = 0").withColumn("key", key_of()).join(solved, "key")
    empty = empty.withColumns({"taken": F.lit(0).cast("long"), "copies": F.lit(0), "rate": F.lit(0.0)}).select(*out)
    return done.unionByName(empty)


def _flipped(taken: DataFrame, flips: DataFrame) -> DataFrame:
    """``taken`` with the repairs applied; at most REPAIRS rows a source in ``flips``."""
    at = ["key", "class", "salt", "k"]
    f = flips.groupBy(*at).agg(F.sum("change").alias("change"))
    return taken.join(f, at, "left").withColumn("copies", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("int")).drop("change")
