"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: presence of each word and of its stem, each pair of neighbours and each pair with one word
between, hashed to ``2**BITS`` coordinates. Presence rather than share, so a remark in a text of
20,000 words weighs as much as in one of ten. Training keeps per-coordinate rates, and its L1 term
leaves few non-zero weights; those are broadcast (at most ``2**BITS``, some thousands in practice).

The settings are chosen by cross-validation inside the rows that labels may be learned from; the held-out
third has no part in it.

Defined cases: null or empty text, or one without words, has only the bias and so the base rate as
its score; null ids score like others, ids may be of any type (labels' ids are read as documents' are); repeated rows give repeated rows; labels that are null or
without a document are not used; a document labelled twice counts as toxic if any label says so;
without any usable label each score is 0.5; a text of any length counts whole, each feature once; an empty
table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mix, word_hashes, words

BITS = 22
#: A word longer than one of these also counts by its first so many letters, for languages that inflect.
STEMS = (4, 5)
#: The model is fit on at most so many labelled rows, picked by a hash of their id.
TRAIN_ROWS = 8_192
THRESHOLD = 0.7


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct coordinates of the text's words, stems, bigrams and one-word skip-grams, ascending."""
    tokens = words(text)
    h = mix(word_hashes(tokens))
    shift = np.uint64(64 - bits)
    turned = (h << np.uint64(23)) | (h >> np.uint64(41))
    parts = [h, mix(turned[:-1] + h[1:]), mix(turned[:-2] ^ h[2:])]
    distinct = set(tokens)
    parts += [word_hashes([f"{w[:n]}-" for w in distinct if len(w) > n]) for n in STEMS]
    return np.unique(np.concatenate(parts) >> shift).astype(np.int32)


@dataclass
class Model:
    """Non-zero weights by ascending coordinate."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, coordinates: np.ndarray) -> float:
        at = np.searchsorted(self.index, coordinates)
        at[at == len(self.index)] = 0
        hit = self.index[at] == coordinates if len(self.index) else np.zeros(len(coordinates), bool)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weight[at[hit]].sum(), -60, 60)))


def fit(
    rows: list[np.ndarray],
    labels: list[int],
    *,
    bits: int = BITS,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.0,
    epochs: int = 6,
) -> Model:
    """FTRL-proximal over the rows, ``epochs`` times in a fixed shuffled order."""
    if not rows:
        return Model(np.empty(0, np.int32), np.empty(0), 0.0, bits)
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = bias = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            p = 1 / (1 + np.exp(-np.clip(bias + w[at].sum(), -60, 60)))
            g = p - labels[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w[at]
            n[at] += g * g
            za = z[at]
            w[at] = np.where(
                np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(n[at])) / alpha + l2)
            )
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * bias
            bn += g * g
            bias = -bz / ((beta + np.sqrt(bn)) / alpha)
    kept = np.flatnonzero(w)
    return Model(kept.astype(np.int32), w[kept], float(bias), bits)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, **options) -> Model:
    """Fits on at most ``rows`` labelled documents outside the held-out fold.

    Only the ids and the coordinates of that bounded sample reach the driver.
    """
    kind = docs.schema["doc_id"].dataType
    key = F.col("doc_id") if labels.schema["doc_id"].dataType == kind else F.col("doc_id").try_cast(kind)
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(key.alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where("doc_id IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "at": pa.array(at, pa.binary())})

    got = picked.mapInArrow(coordinates, f"doc_id {kind.simpleString()}, toxic int, at binary").toArrow()
    # Arrow's rows one batch at a time: the driver holds the sample twice at most.
    found = sorted({(r["doc_id"], r["at"], r["toxic"]) for b in got.to_batches(max_chunksize=256) for r in b.to_pylist()})
    del got
    return fit([np.frombuffer(at, np.int32) for _, at, _ in found], [toxic for _, _, toxic in found], **options)


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            values = np.array([m.score(features(t, m.bits)) for t in b.column("text").to_pylist()], dtype=float)
            out = {c: b.column(c) for c in ("doc_id", "held_out")}
            yield pa.RecordBatch.from_pydict(out | {"score": values, "predicted": (values >= threshold).astype(np.int32)})

    return source.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op2 digest: every document with its score by a model of the labels outside the held-out fold."""
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that are not predicted toxic, columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([bool(m.score(features(t, m.bits)) < threshold) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
