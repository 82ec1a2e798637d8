"""Ranked lexical search: document-sharded CSR postings of integer impacts, read term at a time.

Documents stay in the partition they are read in and are packed into shards of bounded size. A shard is
one row: its documents, its terms, and for each term the documents that hold it (CSR). When the corpus'
counts N and L are known, each posting's frequency becomes its impact, an integer that no query changes.
A query adds weight times impact over its terms to a dense accumulator of the shard's documents; the k-th
best sum is found by argpartition, all sums that reach it are ordered by id, and the k best of each shard
are merged. The weight of a term needs its number of documents in the corpus, summed over shards for the
terms that are asked for.

Queries of BROADCAST bytes in all at most, which is counted, are broadcast, and the index stays where it is. For
more, shards go to shelves and a copy of each block of queries goes to each shelf, so what moves is the index once
and the queries once for each shelf, of which there are MOST_SHELVES at most.

Defined cases: null texts and texts without a term take no part and are not counted in N; a null id takes part
and comes after all ids of its score; rows that share an id are rows of their own; items with
null text or without a known term have no rows; equal items ask once, items that share an id and differ in
text each have their own ranks; an empty table on either side gives an empty result; a text of any length
counts whole (a shard ends after SHARD_TERMS terms, so a very long text has one almost to itself); other
columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import drop_tables, materialise

SHARD_DOCS, SHARD_TERMS = 4_096, 1 << 21
#: Items and distinct terms that travel together.
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 16
MOST_SHELVES = 2_048
#: Bytes of terms, with WIDE for each term besides, up to which what is asked for is broadcast.
BROADCAST, WIDE = 8 << 20, 32
#: Shards in one batch to a Python worker.
BATCH_SHARDS = 4

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(range(0x80, 0x100))
_FOLD = bytes(b if b in _KEPT else 0x20 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A to Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Numbers(dict):
    """term -> its number in the shard."""

    def __missing__(self, term: bytes) -> int:
        self[term] = value = len(self)
        return value


RAW = "ids array<long>, n_docs long, n_terms long, lengths binary, terms binary, offsets binary, docs binary, tf binary"
_RAW = pa.schema([
    ("ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("lengths", pa.binary()),
    ("terms", pa.binary()), ("offsets", pa.binary()), ("docs", pa.binary()), ("tf", pa.binary()),
])


def _packed(ids: list[int | None], found: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
    """One shard's row: postings by term, then document, with their frequencies."""
    lengths = np.array([len(x) for x in found], np.int64)
    keys, tf = np.unique(np.concatenate(found) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    offsets = np.searchsorted(keys, np.arange(len(numbers) + 1) * len(ids))
    row = {
        "ids": ids, "n_docs": len(ids), "n_terms": int(lengths.sum()), "lengths": lengths.tobytes(), "terms": b" ".join(numbers),
        "offsets": offsets.astype(np.int64).tobytes(), "docs": (keys % len(ids)).astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], _RAW)


def shards(docs: DataFrame) -> DataFrame:
    """The documents that have terms, packed where they are read; no row moves."""

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, numbers, held = [], [], _Numbers(), 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = terms(text)
                if not own:
                    continue
                ids.append(doc_id)
                found.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
                held += len(own)
                if len(ids) >= SHARD_DOCS or held >= SHARD_TERMS:
                    yield _packed(ids, found, numbers)
                    ids, found, numbers, held = [], [], _Numbers(), 0
        if ids:
            yield _packed(ids, found, numbers)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sharded, RAW)


def with_impacts(raw: DataFrame, documents: int, total: int) -> DataFrame:
    """The index: frequencies of ``raw`` turned into impacts by the corpus' counts."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = np.array([100 - 25 + 25 * n * documents // total for n in np.frombuffer(r["lengths"], np.int64).tolist()], np.int64)
                tf = np.frombuffer(r["tf"], np.int32).astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[np.frombuffer(r["docs"], np.int32)])
                row = {k: r[k] for k in ("ids", "terms", "offsets", "docs")} | {"impacts": impact.astype(np.int32).tobytes()}
                yield pa.RecordBatch.from_pylist([row], _INDEX)

    return raw.mapInArrow(turned, "ids array<long>, terms binary, offsets binary, docs binary, impacts binary")


_INDEX = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("offsets", pa.binary()), ("docs", pa.binary()), ("impacts", pa.binary())])


def item_terms(items: DataFrame) -> DataFrame:
    """key, item_id, term, n: the terms of each distinct item with their number there."""
    distinct = items.select("item_id", "text").dropDuplicates().select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                found, n = np.unique(np.array(terms(text), object), return_counts=True)
                at = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_pydict({"key": b.column("key").take(at), "item_id": b.column("item_id").take(at), "term": pa.array(found, pa.binary()), "n": pa.array(n, pa.int64())})

    return distinct.mapInArrow(counted, f"key long, item_id {kind}, term binary, n long")


def _met(index: DataFrame, blocks: DataFrame, asked: DataFrame, shelves: int, name: str) -> DataFrame:
    """Each shard with each block of what is asked for; ``asked`` has its terms."""
    size = asked.agg(F.sum(F.length("term") + WIDE).alias("n")).first()["n"] or 0
    one = size <= BROADCAST
    at = F.lit(0) if one else F.pmod("shard", F.lit(shelves)).cast("int")
    copies = blocks.withColumn("shelf", F.lit(0) if one else F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    copies = F.broadcast(copies) if one else materialise(copies, name)
    return index.withColumn("shelf", at).join(copies, "shelf").drop("shelf", "shard")


def weights(index: DataFrame, asked: DataFrame, documents: int, shelves: int) -> DataFrame:
    """term, w of each term that is asked for and occurs."""
    distinct = materialise(asked.select("term").distinct(), "terms")
    count = max(1, -(-distinct.count() // BLOCK_TERMS))
    blocks = distinct.groupBy(F.pmod(F.xxhash64("term"), F.lit(count)).alias("block")).agg(F.collect_list("term").alias("asked")).drop("block")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = dict(zip(r["terms"].split(b" "), np.diff(np.frombuffer(r["offsets"], np.int64)).tolist(), strict=True))
                own = [t for t in r["asked"] if t in sizes]
                yield pa.RecordBatch.from_pydict({"term": pa.array(own, pa.binary()), "df": pa.array([sizes[t] for t in own], pa.int64())})

    pairs = _met(index.select("shard", "terms", "offsets"), blocks, distinct, shelves, "asked-terms")
    df = pairs.mapInArrow(met, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return df.select("term", w.alias("w")).where("w > 0")


def best(scores: np.ndarray, ids: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest sums above 0, ties by id, ``last`` (no id) after those."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        line = own[np.argpartition(own, len(at) - k)[len(at) - k]]
        at = at[own >= line]
    return at[np.lexsort((ids[at], last[at], -scores[at]))[:k]]


def search(docs: DataFrame, items: DataFrame, *, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    raw = materialise(shards(docs), "shards", rows=512)
    n = raw.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t"), F.count("*").alias("s")).first()
    documents, total, shelves = n["d"] or 0, n["t"] or 1, max(1, min(n["s"], MOST_SHELVES))
    index = materialise(with_impacts(raw, documents, total).withColumn("shard", F.monotonically_increasing_id()), "index", rows=BATCH_SHARDS)
    drop_tables(raw)
    asked = materialise(item_terms(items), "item-terms")
    weighed = asked.join(weights(index, asked, documents, shelves), "term")
    queries = weighed.groupBy("key", "item_id").agg(F.collect_list(F.struct("term", (F.col("n") * F.col("w")).alias("w"))).alias("terms"))
    queries = materialise(queries, "queries", rows=BATCH_SHARDS)
    count = max(1, -(-queries.count() // BLOCK_ITEMS))
    blocks = queries.groupBy(F.pmod("key", F.lit(count)).alias("block")).agg(F.collect_list(F.struct("key", "item_id", "terms")).alias("queries")).drop("block")
    kind = items.schema["item_id"].dataType

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                r = {c: one.column(c)[0].as_py() for c in ("terms", "offsets", "docs", "impacts", "queries")}
                held = one.column("ids")[0].values
                ids, last = held.fill_null(0).to_numpy(zero_copy_only=False), np.array(held.is_null())
                number = {t: i for i, t in enumerate(r["terms"].split(b" "))}
                offsets, rows, impacts = (np.frombuffer(r[c], t) for c, t in (("offsets", np.int64), ("docs", np.int32), ("impacts", np.int32)))
                keys, scores, places, which = [], [], [], []
                for q in r["queries"]:
                    sums = np.zeros(len(ids), np.int64)
                    for t in q["terms"]:
                        if (i := number.get(t["term"])) is not None:
                            own = slice(offsets[i], offsets[i + 1])
                            sums[rows[own]] += t["w"] * impacts[own].astype(np.int64)
                    top = best(sums, ids, last, k)
                    keys += [q["key"]] * len(top)
                    which += [q["item_id"]] * len(top)
                    places.append(top)
                    scores.append(sums[top])
                found = held.take(pa.array(np.concatenate(places), pa.int64()))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "item_id": pa.array(which, _arrow(kind)), "doc_id": found, "score": np.concatenate(scores)})

    pairs = _met(index, blocks, queries.select(F.explode("terms.term").alias("term")), shelves, "asked")
    found = materialise(pairs.mapInArrow(searched, f"key long, item_id {kind.simpleString()}, doc_id long, score long"), "found", rows=BATCH_SHARDS)
    drop_tables(index)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: The same from the formulas, over all tokens as rows.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, n GROUP BY term),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT q.item_id, q.text, d.r, d.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * len(d.t) * n.n) // n.l)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), n GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 20"""
