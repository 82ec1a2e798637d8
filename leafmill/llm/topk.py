"""Exact top-k by inner product: an impact-ordered, score-at-a-time index in blocks.

Components are integers. Rows are dealt to blocks of bounded size by a hash of their id. A block's
index holds, for each dimension, its rows by descending value, cut into posting segments of one
quantised impact (``value >> SHIFT``), and the bound of each segment. A query walks the segments of
all dimensions by descending quantised contribution, for negative query components from the low end,
adding to accumulators. It stops only on proof: once the k-th best of the lower bounds is above all
that a row could still reach. The rows that could still be members are then scored exactly.

A query block goes to each index block, which is read once for ASKED_BLOCKS of them: what moves is the
index once for that many query blocks, and the small query blocks. The best k of each block go on with
their ids, so the merge is exact for ties too.

Defined cases: vectors that are null, empty or hold a null, NaN or infinity take no part, nor do null
ids; vectors of unequal length are compared over the components that both have; k above the number
of rows gives all; rows that share an id are rows of their own, each with its own ranks as a query (equal
rows ask once), and a query skips all rows of its id; a block with values too far apart for segments, or too
large for exact sums in doubles, is scored whole in integers of any size, and a score beyond a long's range is
given as its end; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

SCALE = 256
#: Low bits of a value that the posting segments leave out.
SHIFT = 2
BLOCK_ROWS, QUERY_ROWS = 4096, 256
#: Query blocks that one copy of an index block serves, and the tasks that pairs of blocks are dealt to at most.
ASKED_BLOCKS, MOST_TASKS = 16, 2048
#: Widest range of quantised values of a block that has segments.
WIDEST = 1 << 15
#: Rows left for each of the k wanted at which exact scoring is cheaper than walking on.
RESCORED = 4
#: Contributions down to which segments are walked between looks at the bounds, as parts of the largest one.
LEVELS = (0.25, 0.05, 0.0)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floor(256 * x) of each component; unfit vectors are left out."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fit).select("vec_id", whole.alias("v"))


class Index:
    """Posting segments of one block: per dimension its rows by descending value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, postings: np.ndarray | None = None):
        self.ids, self.rows = ids, rows.astype(np.int64)
        self.postings = np.argsort(-self.rows, axis=0, kind="stable").T.astype(np.int32) if postings is None else postings
        coarse = np.take_along_axis(self.rows, self.postings.T.astype(np.int64), axis=0).T >> SHIFT
        self.base = (coarse.astype(np.int64) << SHIFT).ravel()
        self.low, self.high = int(coarse.min()), int(coarse.max())
        self.largest = max(abs(int(self.rows.min())), abs(int(self.rows.max())))
        if self.high - self.low > WIDEST:
            self.above = None
            return
        #: above[d, c - low]: rows of dimension d whose quantised impact is at least c.
        dims, width = coarse.shape[0], self.high - self.low + 2
        flat = (coarse - self.low) + width * np.arange(dims)[:, None]
        held = np.bincount(flat.ravel(), minlength=dims * width).reshape(dims, width)
        self.above = held[:, ::-1].cumsum(axis=1)[:, ::-1]

    def cut(self, q: np.ndarray, t: int) -> np.ndarray:
        """Per dimension, how many postings lie in segments that may contribute ``t`` or more."""
        size = 1 << SHIFT
        c = np.zeros(len(q), np.int64)
        up, down = q > 0, q < 0
        c[up] = (-((-t) // q[up]) + size) // size - 1  # largest value of the segment times q reaches t
        c[down] = ((-t) // -q[down]) // size + 1  # smallest value times q reaches t below this segment
        at = np.clip(c - self.low, 0, self.above.shape[1] - 1)
        n = self.above[np.arange(len(q)), at]
        return np.where(up, n, np.where(down, self.rows.shape[0] - n, 0))

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), the query's own id left out, ties to the smaller id."""
        n, dims = self.rows.shape
        use = min(dims, len(query))
        q = np.zeros(dims, np.int64)
        q[:use] = query[:use]
        other = self.ids != query_id
        least = min(k, int(other.sum()))
        if not least:
            return []
        if self.above is None or dims * self.largest * max(1, abs(int(q.min())), abs(int(q.max()))) >= 1 << 53:
            return self._plain(q, np.flatnonzero(other), k)
        part = (1 << SHIFT) - 1
        first, last = self.rows[self.postings[:, 0], np.arange(dims)], self.rows[self.postings[:, -1], np.arange(dims)]
        bottom = np.where(q >= 0, q * (last >> SHIFT << SHIFT), q * ((first >> SHIFT << SHIFT) + part))
        peak = int(np.where(q >= 0, q * ((first >> SHIFT << SHIFT) + part), q * (last >> SHIFT << SHIFT)).max())
        live = np.flatnonzero(q)
        flat_rows, flat_base = self.postings.ravel(), self.base
        # A met posting adds q * base to its row; what the low bits may add or take is fixed per dimension.
        under, slack = np.minimum(q, 0) * part - bottom, np.abs(q) * part + bottom
        done = np.zeros(dims, np.int64)
        lower, gap, met = np.full(n, float(bottom.sum())), np.zeros(n), np.zeros(n, np.int64)
        possible = other
        for level in LEVELS:
            t = int(peak * level) if peak > 0 else int(peak * (2 - level))
            now = np.maximum(self.cut(q, t), done)
            fresh = live[now[live] > done[live]]
            count = now[fresh] - done[fresh]
            if len(fresh):
                start = fresh * n + np.where(q[fresh] > 0, done[fresh], n - now[fresh])
                spans = [slice(i, i + c) for i, c in zip(start.tolist(), count.tolist(), strict=True)]
                rows = np.concatenate([flat_rows[x] for x in spans])
                gain = np.concatenate([flat_base[x] for x in spans]) * np.repeat(q[fresh], count)
                gain += np.repeat(under[fresh], count)
                lower += np.bincount(rows, gain, n)
                gap += np.bincount(rows, np.repeat(slack[fresh], count), n)
                met += np.bincount(rows, minlength=n)
            done = now
            # What is not met yet lies in segments that contribute less than t.
            line = np.partition(lower[other], -least)[-least]
            possible = other & (lower - bottom.sum() + gap + (len(live) - met) * (t - 1) >= line)
            if np.count_nonzero(possible) <= RESCORED * least:
                break
        rows = np.flatnonzero(possible)
        scores = self.rows[rows] @ q
        if len(rows) > 8 * k:
            line = np.partition(scores, -least)[-least]
            rows, scores = rows[scores >= line], scores[scores >= line]
        pick = np.lexsort((self.ids[rows], -scores))[:k]
        return [(int(scores[i]), int(self.ids[rows[i]])) for i in pick]

    def _plain(self, q: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best by sums of any size, for values that segments and doubles do not hold exactly."""
        use = np.flatnonzero(q)
        scores = (self.rows[rows][:, use].astype(object) * q[use].astype(object)).sum(axis=1) if len(use) else np.zeros(len(rows), object)
        held = (max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores)
        return [(-s, i) for s, i in heapq.nsmallest(k, zip((-s for s in held), self.ids[rows].tolist(), strict=True))]


def _stack(vectors: list[list[int]]) -> np.ndarray:
    dims = max(map(len, vectors))
    if all(len(v) == dims for v in vectors):
        return np.array(vectors, np.int64)
    return np.array([list(v) + [0] * (dims - len(v)) for v in vectors], np.int64)


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` dealt to blocks of about ``size`` rows, whatever their ids, one packed row a block."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def pack(key: tuple, b: pa.Table) -> pa.Table:
        m = _stack(b.column("v").to_pylist())
        return pa.table({
            name: pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([m.shape[1]], pa.int32()),
            "ids": pa.array([b.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "keys": pa.array([b.column("key").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "v": pa.array([m.tobytes()], pa.binary()),
        })

    return dealt.groupBy(name).applyInArrow(pack, f"{name} int, dims int, ids binary, keys binary, v binary"), n


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id ``every`` divides."""
    # The key tells rows of one id apart.
    rows = materialise(quantised(vectors).withColumn("key", F.xxhash64("v")), "vectors")
    packed, n = _blocks(rows, BLOCK_ROWS, "block")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = np.frombuffer(r["v"], np.int64).reshape(-1, r["dims"])
                r["postings"] = Index(np.frombuffer(r["ids"], np.int64), m).postings.tobytes()
                yield pa.RecordBatch.from_pylist([r], INDEXED)

    index = materialise(packed.drop("keys").mapInArrow(indexed, "block int, dims int, ids binary, v binary, postings binary"), "index")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates()
    queries, m = _blocks(materialise(asked, "queries"), QUERY_ROWS, "query_block")
    copies = -(-m // ASKED_BLOCKS)
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    queries = materialise(queries.select(F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("v").alias("q_v"), F.col("dims").alias("q_dims"), F.pmod("query_block", F.lit(copies)).alias("copy")), "asked")
    queries = queries.withColumn("block", numbers(n))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, dims = np.frombuffer(r["ids"], np.int64), r["dims"]
                own = Index(ids, np.frombuffer(r["v"], np.int64).reshape(-1, dims), np.frombuffer(r["postings"], np.int32).reshape(dims, -1))
                asked_ids, keys = (np.frombuffer(r[c], np.int64).tolist() for c in ("q_ids", "q_keys"))
                found = [(q, key, *x) for q, key, v in zip(asked_ids, keys, np.frombuffer(r["q_v"], np.int64).reshape(-1, r["q_dims"]), strict=True) for x in own.top(q, v, k)]
                q, key, score, vec = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in (("query_id", q), ("query_key", key), ("score", score), ("vec_id", vec))})

    # A pair of blocks is little to read and much to work out, so both sides are dealt by number, not by size,
    # and the search runs where they meet.
    tasks, place = min(n * copies, MOST_TASKS), ["block", "copy"]
    spread = index.withColumn("copy", numbers(copies)).repartition(tasks, *place)
    pairs = spread.join(queries.repartition(tasks, *place).hint("shuffle_merge"), place)
    found = pairs.mapInArrow(searched, "query_id long, query_key long, score long, vec_id long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


INDEXED = pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("postings", pa.binary())])

#: The same as sums of products over all pairs of a query and another row.
ORACLE = f"""WITH x AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS (SELECT r, vec_id, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS c, generate_subscripts(embedding, 1) AS k FROM x),
q AS (SELECT * FROM v WHERE r IN (SELECT min(r) FROM x WHERE vec_id % 50 = 0 GROUP BY vec_id, embedding)),
s AS (SELECT q.vec_id AS query_id, q.r AS q, v.vec_id, v.r, CAST(sum(q.c * v.c) AS BIGINT) AS score FROM q JOIN v ON v.k = q.k AND v.vec_id <> q.vec_id GROUP BY ALL),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM o WHERE rank <= 5"""
