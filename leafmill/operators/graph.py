"""Components of a graph given as edges, and the cut of lineage that rounds need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.batches import ddl, fresh, whole_groups
from leafmill.sources.files import scratch


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins by shuffle: Spark takes exploded rows, and what is made of them, for no larger than their source, and would
    broadcast through the driver what grows with the input."""
    return df.hint("merge")


#: Edges of one key that a task unites by itself.
AT_ONCE = 1 << 21


def _hooked(edges: DataFrame, keys: list[str], *, upward: bool) -> DataFrame:
    """Each node's neighbours on one side are hung on its least neighbour or itself, whichever is less."""
    if upward:
        around = edges.select(*keys, F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(*keys, F.col("b").alias("n"), F.col("a").alias("m")))
        kept = F.col("m") > F.col("n")
    else:
        around = edges.select(*keys, F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
        kept = F.lit(True)
    least = around.groupBy(*keys, "n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
    out = around.where(kept).join(shuffled(least), [*keys, "n"]).select(*keys, F.col("m").alias("a"), F.col("least").alias("b"))
    if not upward:
        out = out.union(least.select(*keys, F.col("n").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, keys: list[str], *, rounds: int = 64) -> DataFrame:
    """keys, node, root: the least node of each component of ``edges`` (keys, a, b); nodes are of one ordered type.

    Stars are merged alternately upwards and downwards until no edge changes; every round is a few joins
    on nodes, however large a component or the neighbourhood of a node is. Edges that join a node to itself give
    no row.
    """
    held = cut(edges.select(*keys, "a", "b").where("a <> b").distinct())
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("s")]
    before = held.agg(*mark).first()
    for _ in range(rounds):
        held = cut(_hooked(_hooked(held, keys, upward=True), keys, upward=False))
        now = held.agg(*mark).first()
        if now == before:
            return held.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).union(held.select(*keys, F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its component; a and b are the ends of edges."""
    least = np.arange(n)
    while len(a):
        one, two = least[a], least[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(least, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(up := least[least], least):
            least = up
    return least


def _united(rows: pa.Table, keys: list[str]) -> pa.Table:
    """keys, node, root of the edges of whole groups."""
    group, a, b = np.tile(np.cumsum(fresh(rows, keys)), 2), rows.column("a").to_numpy(), rows.column("b").to_numpy()
    ends = np.concatenate([a, b])
    order = np.lexsort((ends, group))
    new = np.append(True, (np.diff(group[order]) != 0) | (np.diff(ends[order]) != 0))
    at, name = order[new], np.empty(len(ends), np.int64)
    name[order] = np.cumsum(new) - 1
    node = ends[at]
    root = node[_least(name[: len(a)], name[len(a) :], len(at))]
    held = rows.select(keys).take(pa.array(at % len(a)))
    return held.append_column("node", pa.array(node)).append_column("root", pa.array(root))


def united(edges: DataFrame, keys: list[str], *, at_once: int = AT_ONCE) -> DataFrame:
    """``components`` of graphs whose nodes are longs and of which most are small: one of up to ``at_once`` edges is united in one
    task, larger ones in rounds."""
    held = cut(edges.select(*keys, "a", "b").where("a <> b").distinct())
    large = cut(held.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > at_once).drop("n"))
    some = not large.isEmpty()
    few = held.join(shuffled(large), keys, "left_anti") if some else held
    few = few.repartition(*keys).sortWithinPartitions(*keys)

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            yield from _united(rows, keys).to_batches()

    out = few.mapInArrow(unite, f"{ddl(held.select(*keys))}, node long, root long")
    return out.unionByName(components(held.join(shuffled(large), keys, "left_semi"), keys)) if some else out
