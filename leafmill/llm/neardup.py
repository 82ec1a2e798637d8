"""Near-duplicates: ProbMinHash signatures of shingles, banding and verification.

Shingles are runs of five words. Each shingle is a Poisson process of arrivals at the rate of its weight,
each arrival falls on a random register, and a register keeps its first one. Two texts agree on a register
with their probability Jaccard similarity. Processes run in blocks of arrivals and end early, once their
next arrival is later than every register's. A shingle weighs 1 plus the logarithm of its count, so repeated
passages tell texts apart but do not drown the rest. Links are verified by the similarity of shingle sets, which
a passage that repeats can hide from the weights: a text with repeats has a signature of its plain set too, and
texts without repeats have both in one. So pairs meet by either similarity, and the weights lose no link.

1. Texts with the same words are one exact class; one row per class goes on.
2. Signatures are cut into bands, both kinds alike; classes that share a band are a bucket.
3. In each bucket every member is verified against its leader, not against every other member, so a
   bucket of any size gives one pair a member. A link is verified on the whole texts: the Jaccard
   similarity of the two shingle sets is at least the threshold. Members that this leaves outside the
   largest component of their bucket are verified against another member of it, PIVOTS times.
4. Buckets that still hold several components go through an exact index. Shingles that only one component
   holds come first, the rest by how many texts hold them; of two linked sets each has one of the other's
   shingles among its first n - threshold * n + 1, so texts meet only on a shingle of both these prefixes
   that several components hold, within the bounds of sizes and places, and are verified. No link in a
   bucket is lost to the choice of leaders or to an estimate. Only a pair that shares no band can be
   lost, at similarity s of the sets with probability (1 - s**5)**24 at most: 7e-5 at 0.8.
5. Components of all links are the classes; copies get the class of their text.

A text with fewer than five words is one shingle of all its words. Defined cases: null and empty
texts are one exact class, linked to nothing else; a text without words is equal only to texts with
the same characters; rows with a null doc_id take no part and get a null class; rows that share a
doc_id share a class, whatever their texts; ties go to the smallest doc_id; ids may be of any type that has
an order and class ids have theirs; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import drop_tables, materialise, mix, windows, word_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Further members of a bucket's largest component that those outside it are verified against.
PIVOTS = 2
#: Rows of a file of a round of components, about.
ROUND_ROWS = 250_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """uint64 hashes of the text's shingles in order, repeats kept."""
    h = word_hashes(words(text))
    return windows(h, min(size, len(h))) if len(h) else h


def content_key(text: str | None) -> tuple[int, int]:
    """128-bit identity of the words of a text; of its characters if it has no word."""
    tokens = words(text)
    key = xxhash.xxh3_128_intdigest("\n".join(tokens) if tokens else "\0" + (text or ""))
    return (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63)


def _uniform(draw: np.ndarray) -> np.ndarray:
    return ((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _draws(elements: np.ndarray, first: int, k: int) -> np.ndarray:
    """Draws first, first + 1, ... of each element's own sequence, one row an element."""
    return mix(elements[:, None] + np.arange(first, first + k, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95))


def _arrivals(elements: np.ndarray, weights: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, element) of each register's first arrival."""
    first, held = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    alive, time, weight, done = elements, np.zeros(len(elements)), weights, 0
    while len(alive):
        k = max(2 if done else 1, -(-8 * registers // len(alive)) if not done else 0)
        draw = _draws(alive, done, k)
        arrival = time[:, None] + np.cumsum(-np.log(_uniform(draw)) / weight[:, None], axis=1)
        at, who, when = (mix(draw) % np.uint64(registers)).astype(np.int64).ravel(), np.repeat(alive, k), arrival.ravel()
        np.minimum.at(first, at, when)
        best = when == first[at]
        held[at[best]] = who[best]
        time, done = arrival[:, -1], done + k
        stays = time < first.max()
        alive, time, weight = alive[stays], time[stays], weight[stays]
    return first, held


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """int32 signature of distinct uint64 elements with positive weights."""
    if not len(elements):
        return np.zeros(registers, np.int32)
    horizon = 12 * registers / weights.sum()
    some = slice(None)
    if len(elements) > 12 * registers:
        # Elements whose first arrival is later than the horizon matter only if some register is still free then.
        some = np.flatnonzero(_uniform(_draws(elements, 0, 1)[:, 0]) > np.exp(-horizon * weights))
    first, held = _arrivals(elements[some], weights[some], registers)
    if first.max() >= horizon and len(held) and not isinstance(some, slice):
        first, held = _arrivals(elements, weights, registers)
    return (mix(held) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """int64 key of each band, the band's number in it."""
    rows = signature.view(np.uint32).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key ^ rows[:, k])
    return key.view(np.int64)


def bands_of(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """int64 keys of the bands of distinct shingles and their counts; where one repeats, those of the plain set beside the weighted ones."""
    if not len(elements):
        return np.empty(0, np.int64)
    keys = band_keys(prob_min_hash(elements, 1 + np.log(counts)))
    return np.union1d(keys, band_keys(prob_min_hash(elements, np.ones(len(elements))))) if counts.max() > 1 else keys


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (identity of the words), bands (none for a text without words) of every row with an id."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            keys, bands = [], []
            for t in b.column("text").to_pylist():
                key = content_key(t)
                if key not in seen:
                    elements, n = np.unique(shingles(t), return_counts=True)
                    if len(seen) >= 4096:
                        seen.clear()
                    seen[key] = bands_of(elements, n)
                keys.append(key)
                bands.append(seen[key])
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else [], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.ListArray.from_arrays(ends, flat)],
                names=["doc_id", "h1", "h2", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.where("doc_id is not null").select("doc_id", "text")
    return ids.mapInArrow(signed, f"doc_id {kind}, h1 long, h2 long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and sorted shingle set of the documents in ``wanted`` (id, h1, h2)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            rows = zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("text").to_pylist(), strict=True)
            for i, (h1, h2, t) in enumerate(rows):
                if content_key(t) == (h1, h2):
                    at.append(i)
                    found.append(np.unique(shingles(t)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.where("doc_id is not null").select("doc_id", "text")
    # Repeated rows of a document are one; the join has brought them together.
    rows = held.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id").dropDuplicates(["doc_id", "text"])
    return rows.mapInArrow(sets, f"id {kind}, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets have Jaccard similarity ``threshold`` or more."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared >= threshold * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id, label of every linked id; label is the least id of its connected component.

    Least neighbours' labels spread with pointer jumping until nothing changes; each round cuts its
    lineage. Hubs are summed map-side. Rounds of small graphs are written as few files.
    """
    links = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    files = 1 + links.count() // ROUND_ROWS
    labels = materialise(links.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")).coalesce(files), name)
    while True:
        seen = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("n_id")).agg(F.min("label").alias("near"))
        spread = labels.join(seen, labels["id"] == seen["n_id"], "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("j_id"), F.col("label").alias("j_label"))
        after = spread.join(jump, spread["label"] == jump["j_id"], "left").select("id", "old", F.least("label", F.coalesce("j_label", "label")).alias("label"))
        after = materialise(after.coalesce(files), name)
        drop_tables(labels)
        changed = not after.where("label <> old").isEmpty()
        labels = after.select("id", "label")
        if not changed:
            drop_tables(links)
            return labels


def classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id of every row of ``docs``; class_id is the least doc_id of its class."""
    signed = materialise(signatures(docs), "signatures")
    # One row per distinct words: the least id, with its bands.
    reps = materialise(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "representatives")

    members = reps.select("id", F.explode("bands").alias("bucket"))
    # Leaders are the least of a hash of their id, so buckets of one group mostly share theirs.
    order = F.struct(F.xxhash64("id").alias("o"), F.col("id").alias("leader"))
    buckets = members.groupBy("bucket").agg(F.min(order).alias("least"), F.count("*").alias("size")).where("size > 1")
    shared = materialise(members.join(buckets.select("bucket", "least.leader"), "bucket"), "buckets")

    pairs = materialise(shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = materialise(shingle_sets(docs, reps.select("id", "h1", "h2").join(named, "id")), "sets")
    links = materialise(verified(pairs, sets, threshold), "links")
    drop_tables(pairs)
    labels = components(links, "first")

    found = [links]
    for k in range(PIVOTS):
        more = materialise(_pivots(_split(shared, labels), k), "pivots")
        if more.isEmpty():
            break
        found.append(materialise(verified(more, sets, threshold), "joined"))
        drop_tables(more)
        if not found[-1].isEmpty():
            before, labels = labels, components(_all(found), "again")
            drop_tables(before)
    apart = _split(shared, labels).select("id", "label").distinct()
    candidates = materialise(candidates_apart(materialise(apart.join(sets, "id"), "apart"), threshold), "candidates")
    extra = materialise(verified(candidates, sets, threshold), "extra")
    drop_tables(sets, shared, candidates)
    if not extra.isEmpty():
        labels = components(_all([*found, extra]), "last")
    per_text = reps.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("class_id"))
    return docs_classes(docs, signed, per_text)


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _split(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, id, label of the members of buckets that hold several components."""
    labelled = shared.select("bucket", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return labelled.join(several.select("bucket"), "bucket")


def _pivots(split: DataFrame, k: int) -> DataFrame:
    """(a, b): of each split bucket a member of its largest component with every member outside it."""
    each = split.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("o"), F.col("id").alias("pivot"))).alias("p"))
    largest = each.groupBy("bucket").agg(F.max(F.struct("c", "label", F.col("p.pivot").alias("pivot"))).alias("m")).select("bucket", F.col("m.label").alias("largest"), "m.pivot")
    out = split.join(largest, "bucket").where("label <> largest")
    return out.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()


def candidates_apart(apart: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): the pairs of different labels in ``apart`` (id, label, set) that can be links.

    A prefix index: see step 4 above. Shingles of one label only are not joined at all.
    """
    each = apart.select("id", "label", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("held"), F.min("label").alias("least"), F.max("label").alias("most"))
    several = held.where("least <> most").select("shingle", "held")
    rows = each.join(several, "shingle").groupBy("id").agg(
        F.first("label").alias("label"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("ordered")
    )
    alone = F.col("n") - F.size("ordered")
    prefix = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1
    tokens = rows.where(prefix > alone).select("id", "label", "n", alone.alias("alone"), F.posexplode(F.slice("ordered", F.lit(1), prefix - alone)).alias("at", "o"))
    # rest: shingles from this one on in the text's order.
    tokens = materialise(tokens.select("id", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), F.col("o.shingle").alias("shingle")), "prefixes")
    a, b = (tokens.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "label", "n", "rest"))) for s in "ab")
    most = F.least("rest_a", "rest_b")
    fits = (F.col("label_a") < F.col("label_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (most >= threshold * (F.col("n_a") + F.col("n_b") - most) - 1e-9)
    same = a["shingle"] == b["shingle"]
    return a.join(b, same & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def docs_classes(docs: DataFrame, signed: DataFrame, per_text: DataFrame) -> DataFrame:
    """Class ids of all rows from those of the distinct texts.

    Most texts have one row; classes of many rows are the hot keys, and adaptive execution splits
    their side of the join. Both sides are narrow.
    """
    rows = signed.select("doc_id", "h1", "h2").join(per_text, ["h1", "h2"]).select("doc_id", "class_id")
    if docs.schema["doc_id"].nullable:
        kind = docs.schema["doc_id"].dataType
        rows = rows.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast(kind).alias("class_id")))
    return rows


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: of each class the row with the least doc_id stays, and rows without an id.

    Of several rows with that id the first by a hash of all its other columns stays, one of equal rows.
    Columns as they came, whatever their names and types.
    """
    every = materialise(classes(docs, threshold=threshold), "classes")
    gone = every.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = every.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    rows = kept.join(twice, "doc_id").select("doc_id", F.struct(*docs.columns).alias("row"))
    # A row as JSON has an order whatever its types; its hash comes first.
    text = F.to_json("row")
    one = rows.groupBy("doc_id").agg(F.min_by("row", F.struct(F.xxhash64(text), text)).alias("row"))
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))
