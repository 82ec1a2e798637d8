"""Vector codes: product quantisation whose rounds of Lloyd keep a heap of slacks for each entry.

A vector of integers is cut into PARTS equal parts; each part position has a codebook of ENTRIES. A part that has
been scanned knows the distance to its entry and to the next best one. It can only change its entry once the
moves of the entries since then, its own and the largest of the others', add up to that difference. So each
entry sums up these moves (its drift), and keeps its parts in a heap by slack, the lower bound of the
others less the upper bound of its own, plus the drift when they came in. A round pops the parts whose key the
drift has reached, no others, scans them exactly, and pushes each with a new key to the entry it now has.

Vectors are packed into shards in the partition they are read in; heaps are the shard's own. A shard's row holds
its vectors, entries and heaps and is written after each round, so a lost executor costs tasks of one round.
Of the sums of parts a shard hands on only those of entries whose parts changed; Spark adds them up, and the
driver holds codebooks, at most PARTS x ENTRIES vectors.

Keys are doubles and are rounded towards a scan; distances, sums and entries are integers and exact.

Defined cases: a vector that is null or holds a null, NaN or infinity is left out; shorter vectors, empty ones too,
are filled with zeros to the longest, rounded up to a multiple of PARTS; components are held within the range in
which every error fits a long (131,072 at 64 components); rows that share an id are rows of their own,
ordered by their vectors; null ids come last; with fewer than ENTRIES rows each starts an entry; equal entries
are decided by the lower index; null labels are one group; an empty table gives an empty result; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import drop_tables, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SHARD_ROWS = 1 << 15
BATCH_SHARDS = 4
#: Parts whose distances to all entries are held at once.
SCANNED = 4_096


def fit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part, v not held within a range yet."""
    component = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", component).alias("v"))


def bound(dims: int) -> int:
    """Largest component at which the squared distance of two vectors fits a long."""
    return min(1 << 30, 1 << ((62 - max(0, dims - 1).bit_length()) // 2 - 1))


def matrix(rows: list[list[int]], dims: int) -> np.ndarray:
    """``rows`` filled with zeros to ``dims`` and held within ``bound``."""
    most, out = bound(dims), np.zeros((len(rows), dims), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return np.clip(out, -most, most)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts to entries, exact."""
    most = max([1, *(int(np.abs(x).max()) for x in (parts, book) if x.size)])
    if 4 * max(1, parts.shape[1]) * most * most < 1 << 53:  # then each term is a whole number that doubles hold
        p, b = parts.astype(float), book.astype(float)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((parts - e) ** 2).sum(axis=1) for e in book], axis=1)


def scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equals), its squared distance, and the slack to the second."""
    entry, own, slack = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.full(len(parts), np.inf)
    for a in range(0, len(parts), SCANNED):
        d, z = distances(parts[a : a + SCANNED], book), slice(a, a + SCANNED)
        at = np.arange(len(d))
        entry[z] = d.argmin(axis=1)
        own[z] = d[at, entry[z]]
        if len(book) > 1:
            d[at, entry[z]] = np.iinfo(np.int64).max
            upper, lower = np.sqrt(own[z].astype(float)), np.sqrt(d.min(axis=1).astype(float))
            slack[z] = lower - upper - 1e-9 * (1 + lower)
    return entry, own, slack


class Heaps:
    """One part position of one shard: its entries, and the members of each entry as a heap of (key, row)."""

    def __init__(self, entry: np.ndarray, keys: np.ndarray, members: np.ndarray, starts: np.ndarray):
        self.entry = entry
        cut = [slice(*x) for x in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        self.held: list[list[tuple[float, int]] | tuple[np.ndarray, np.ndarray]] = [(keys[c], members[c]) for c in cut]

    @classmethod
    def empty(cls, entry: np.ndarray, entries: int) -> Heaps:
        return cls(entry, np.empty(0), np.empty(0, np.int32), np.zeros(entries + 1, np.int64))

    def _list(self, e: int) -> list[tuple[float, int]]:
        if isinstance(self.held[e], tuple):
            self.held[e] = list(zip(*(x.tolist() for x in self.held[e]), strict=True))
        return self.held[e]

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Pops the rows whose key the drift of their entry has reached."""
        out = []
        for e, h in enumerate(self.held):
            first = (h[0][0] if len(h[0]) else np.inf) if isinstance(h, tuple) else (h[0][0] if h else np.inf)
            if first > drift[e]:
                continue
            heap = self._list(e)
            while heap and heap[0][0] <= drift[e]:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, rows: np.ndarray, entry: np.ndarray, keys: np.ndarray) -> None:
        self.entry[rows] = entry
        order = np.argsort(entry, kind="stable")
        starts = np.searchsorted(entry[order], np.arange(len(self.held) + 1))
        for e in np.flatnonzero(np.diff(starts)).tolist():
            new = order[starts[e] : starts[e + 1]]
            heap = self._list(e)
            more = list(zip(keys[new].tolist(), rows[new].tolist(), strict=True))
            if len(more) > len(heap):
                heap += more
                heapq.heapify(heap)
            else:
                for x in more:
                    heapq.heappush(heap, x)

    def arrays(self) -> tuple[bytes, bytes, bytes, bytes]:
        keys, members, sizes = [], [], []
        for h in self.held:
            k, m = h if isinstance(h, tuple) else (np.array([x[0] for x in h], float), np.array([x[1] for x in h], np.int32))
            keys.append(k)
            members.append(m)
            sizes.append(len(k))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return self.entry.astype(np.int32).tobytes(), np.concatenate(keys).tobytes(), np.concatenate(members).astype(np.int32).tobytes(), starts.astype(np.int64).tobytes()


def changed_sums(parts: np.ndarray, rows: np.ndarray, before: np.ndarray, after: np.ndarray, entries: int) -> list[tuple[int, int, list[int]]]:
    """(entry, count, sums) that the changes of ``rows`` add to or take from entries; -1 is no entry yet."""
    moved = before != after
    rows, before, after = rows[moved], before[moved], after[moved]
    n, total = np.zeros(entries, np.int64), np.zeros((entries, parts.shape[1]), np.int64)
    for sign, e in ((1, after), (-1, before)):
        known = e >= 0
        n += sign * np.bincount(e[known], minlength=entries)
        np.add.at(total, e[known], sign * parts[rows[known]])
    touched = np.unique(np.concatenate([after, before[before >= 0]])).tolist()
    return [(e, int(n[e]), total[e].tolist()) for e in touched]


class Books:
    """Codebooks of all parts, the sums of their members, and each entry's drift; as large for any corpus."""

    def __init__(self, books: np.ndarray):
        self.books, self.drift = books, np.zeros(books.shape[:2])
        self.count, self.total = np.zeros(books.shape[:2], np.int64), np.zeros_like(books)

    def updated(self, changes: list[tuple[int, int, int, list[int]]]) -> None:
        """Adds (part, entry, count, sums), moves entries to floor(sum / count) and lets drifts grow."""
        for part, entry, n, s in changes:
            self.count[part, entry] += n
            self.total[part, entry] += np.array(s, np.int64)
        new = np.where(self.count[:, :, None] > 0, self.total // np.maximum(self.count, 1)[:, :, None], self.books)
        moved = np.sqrt(((new - self.books).astype(float) ** 2).sum(axis=2))
        for p, m in enumerate(moved):
            others = np.full(len(m), m.max(initial=0.0))
            if len(m) > 1:
                others[m.argmax()] = np.partition(m, -2)[-2]
            self.drift[p] += (m + others) * (1 + 1e-9)
        self.books = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


STATE = "ids array<long>, labels array<long>, n int, v binary, heaps array<struct<entry:binary,keys:binary,members:binary,starts:binary>>, changes array<struct<part:int,entry:int,n:long,s:array<long>>>"
_HEAP = pa.struct([(c, pa.binary()) for c in ("entry", "keys", "members", "starts")])
_CHANGE = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("n", pa.int32()), ("v", pa.binary()), ("heaps", pa.list_(_HEAP)), ("changes", pa.list_(_CHANGE))])


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """Shards of the rows, where they are read, without heaps yet."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []

        def shard() -> pa.RecordBatch:
            v = matrix(held, dims)
            return pa.RecordBatch.from_pylist([{"ids": ids, "labels": labels, "n": len(ids), "v": v.astype(np.int32).tobytes(), "heaps": [], "changes": []}], _STATE)

        for b in batches:
            for r in b.to_pylist():
                ids.append(r["vec_id"])
                labels.append(r["label"])
                held.append(r["v"])
                if len(ids) >= SHARD_ROWS:
                    yield shard()
                    ids, labels, held = [], [], []
        if ids:
            yield shard()

    return rows.mapInArrow(pack, STATE)


def assigned(shards: DataFrame, state: Books, dims: int) -> DataFrame:
    """One round over all shards: pops what drift has violated, scans it, pushes it again."""
    books, drift, width = state.books, state.drift, dims // PARTS
    entries = books.shape[1]

    def one(r: dict) -> dict:
        v = np.frombuffer(r["v"], np.int32).reshape(r["n"], dims).astype(np.int64)
        heaps, changes = [], []
        for p in range(PARTS):
            parts = v[:, p * width : (p + 1) * width]
            if r["heaps"]:
                h = r["heaps"][p]
                own = Heaps(*(np.frombuffer(h[c], t).copy() for c, t in (("entry", np.int32), ("keys", float), ("members", np.int32), ("starts", np.int64))))
                rows = own.violated(drift[p])
            else:
                own, rows = Heaps.empty(np.full(r["n"], -1, np.int32), entries), np.arange(r["n"])
            before = own.entry[rows].astype(np.int64)
            entry, _, slack = scan(parts[rows], books[p])
            own.push(rows, entry, slack + drift[p][entry])
            changes += [{"part": p, "entry": e, "n": n, "s": s} for e, n, s in changed_sums(parts, rows, before, entry, entries)]
            heaps.append(dict(zip(("entry", "keys", "members", "starts"), own.arrays(), strict=True)))
        return r | {"heaps": heaps, "changes": changes}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([one(b.slice(at, 1).to_pylist()[0])], _STATE)

    return shards.mapInArrow(each, STATE)


def changes(shards: DataFrame, width: int) -> list[tuple[int, int, int, list[int]]]:
    """The shards' changes added up by Spark: at most one row a part and entry."""
    each = shards.select(F.explode("changes").alias("c"))
    sums = [F.sum(F.col("c.s")[k]).alias(f"s{k}") for k in range(width)]
    got = each.groupBy("c.part", "c.entry").agg(F.sum("c.n").alias("n"), *sums).collect()
    return [(r["part"], r["entry"], r["n"], [r[f"s{k}"] for k in range(width)]) for r in got]


def coded(shards: DataFrame, state: Books, dims: int) -> DataFrame:
    """vec_id, label, code, error of every row by its entries."""
    books, width = state.books, dims // PARTS

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                n, heaps = one.column("n")[0].as_py(), one.column("heaps")[0].as_py()
                v = np.frombuffer(one.column("v")[0].as_py(), np.int32).reshape(n, dims).astype(np.int64)
                entries = np.stack([np.frombuffer(h["entry"], np.int32) for h in heaps], axis=1)
                error = sum(((v[:, p * width : (p + 1) * width] - books[p][entries[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
                text = ["".join(f"{e:02x}" for e in row) for row in entries.tolist()]
                yield pa.RecordBatch.from_pydict({"vec_id": one.column("ids")[0].values, "label": one.column("labels")[0].values, "code": pa.array(text, pa.string()), "error": error})

    return shards.mapInArrow(code, "vec_id long, label long, code string, error long")


def train(vectors: DataFrame, *, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books, int]:
    """The shards with their last entries, the codebooks, and the components of a vector."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry has to fit two hex digits")
    rows = materialise(fit_rows(vectors), "vectors")
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    dims = -(-longest // PARTS) * PARTS
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = matrix([r["v"] for r in first], dims)
    state = Books(np.ascontiguousarray(start.reshape(len(first), PARTS, dims // PARTS).swapaxes(0, 1)))
    shards = materialise(packed(rows, dims), "shards", rows=SHARD_ROWS)
    drop_tables(rows)
    for k in range(rounds + 1):
        after = materialise(assigned(shards, state, dims), f"round-{k}", rows=BATCH_SHARDS)
        drop_tables(shards)
        shards = after
        if k < rounds:
            state.updated(changes(shards, dims // PARTS))
    return shards, state, dims


def vector_codes(vectors: DataFrame) -> DataFrame:
    """The op13 digest: code and error of every vector, the errors of its label, a hash of the codebooks."""
    shards, state, dims = train(vectors)
    out = materialise(coded(shards, state, dims), "codes", rows=BATCH_SHARDS)
    drop_tables(shards)
    labels = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = out.join(labels, out["label"].eqNullSafe(labels["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(state.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same as rounds of plain assignments over all parts and entries."""
    steps = [
        "x AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"v AS MATERIALIZED (SELECT r, (k - 1) // (n // {PARTS}) AS p, (k - 1) % (n // {PARTS}) AS j, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS c FROM (SELECT r, len(embedding) AS n, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS k FROM x))",
        f"b0 AS (SELECT p, r AS e, j, c FROM v WHERE r < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT v.r, v.p, b.e, CAST(sum((v.c - b.c) * (v.c - b.c)) AS BIGINT) AS d FROM v JOIN b{k} b ON b.p = v.p AND b.j = v.j GROUP BY v.r, v.p, b.e) GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c FROM v JOIN a{k} USING (r, p) GROUP BY p, e, j) m ON m.p = b.p AND m.e = b.e AND m.j = b.j)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS s FROM b{ROUNDS})")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM o JOIN x USING (r), h"


ORACLE = _oracle()
