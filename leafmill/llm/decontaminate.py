"""Benchmark decontamination by greedy string tiling.

A test item shares seeds (runs of five words) with a document or it cannot have a tile there; seeds
of both are joined first. For each pair that shares one, running Karp-Rabin hashes give the matches
of five words and more; the longest match that touches no marked word is marked in both texts, again
and again, until none is left. Tiles do not overlap, so coverage, the marked share of the item's
words, counts a passage once however often it stands in the document, and sentences in another order
count like those in place.

Two repetitive texts can share as many seed pairs as the product of their lengths. Beyond SEED_PAIRS the
same tiling is found without listing them: the longest length that both texts still share unmarked is
searched by rolling hashes of all windows of a length, and its matches are marked from left to right.

The seeds of the items are broadcast in slices of at most SLICE_CHARS characters of item text; a
benchmark of more takes several passes over the documents, one slice at a time: each result is written
and the slice dropped before the next, so what executors and driver hold stays bounded.

Defined cases: null or empty texts and items, and items of fewer than five words, have no tile; null
ids of documents or items take part with null in the pair; repeated rows give repeated pairs; an
item row that repeats an id and a text counts once; of equally long matches the first in the document, then
in the item, is marked first; ids may be of any type; other columns, whatever their names, play no part
and the stage returns them as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import materialise, windows, word_hashes, words

MIN_MATCH = 5
#: Share of an item's words under tiles from which a document contains it.
COVERAGE = 0.5
SLICE_CHARS = 16_000_000
#: Pairs of equal seeds of two texts that are listed at once.
SEED_PAIRS = 1 << 18


def tiles(doc: np.ndarray, item: np.ndarray, shortest: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words) of the greedy tiling of two arrays of word hashes."""
    a, b = windows(doc, shortest), windows(item, shortest)
    order = np.argsort(b, kind="stable")
    keys = b[order]
    near = np.flatnonzero(np.isin(a, keys))
    low, high = np.searchsorted(keys, a[near], "left"), np.searchsorted(keys, a[near], "right")
    reps = high - low
    if reps.sum() > SEED_PAIRS:
        return _tiles_by_length(doc, item, shortest)
    at_doc = np.repeat(near, reps)
    at_item = order[np.repeat(low, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
    # Seeds on one diagonal that follow each other are one match.
    diagonal = at_doc - at_item
    o = np.lexsort((at_doc, diagonal))
    at_doc, at_item, diagonal = at_doc[o], at_item[o], diagonal[o]
    starts = np.flatnonzero(np.r_[True, (diagonal[1:] != diagonal[:-1]) | (at_doc[1:] != at_doc[:-1] + 1)]) if len(o) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[starts, len(o)]) + shortest - 1
    by_length: dict[int, list[tuple[int, int]]] = {}
    for s, n in zip(starts, lengths, strict=True):
        by_length.setdefault(int(n), []).append((int(at_doc[s]), int(at_item[s])))
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while by_length:
        n = max(by_length)
        for i, j in sorted(by_length.pop(n)):
            taken = used_doc[i : i + n] | used_item[j : j + n]
            if not taken.any():
                used_doc[i : i + n] = used_item[j : j + n] = True
                out.append((i, j, n))
                continue
            # What is left of the match between marked words comes up again at its own length.
            free = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
            for a0, a1 in zip(free[::2], free[1::2], strict=True):
                if a1 - a0 >= shortest:
                    by_length.setdefault(int(a1 - a0), []).append((i + int(a0), j + int(a0)))
    return out


class _Rolling:
    """Hashes of all windows of any length of a text, and which windows are free of marks."""

    def __init__(self, text: np.ndarray):
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.n = len(text)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.n, base)])
        # Position k counts text[k] * base**k; a window's sum is brought to the same power as all others.
        self.sums = np.r_[np.uint64(0), np.cumsum(text * self.power[: self.n])]
        self.used = np.zeros(self.n, bool)

    def free(self, size: int) -> np.ndarray:
        """Starts of the windows of ``size`` words without a mark."""
        marked = np.r_[0, np.cumsum(self.used)]
        return np.flatnonzero(marked[size:] == marked[: self.n - size + 1]) if size <= self.n else np.empty(0, np.int64)

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.power[self.n - starts - size]


def _tiles_by_length(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """``tiles`` in memory in proportion to the texts."""
    with np.errstate(over="ignore"):
        a, b = _Rolling(doc), _Rolling(item)
        # Both texts' windows get the power of the longer one.
        lift = [np.uint64(1), np.uint64(1)]
        lift[a.n > b.n] = (a.power if a.n > b.n else b.power)[abs(a.n - b.n)]

        def both(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            i, j = a.free(size), b.free(size)
            return i, j, a.hashes(i, size) * lift[0], b.hashes(j, size) * lift[1]

        def shared(size: int) -> bool:
            i, j, x, y = both(size)
            return bool(len(i) and len(j) and np.isin(x, y).any())

        out, longest = [], min(a.n, b.n)
        while longest >= shortest and shared(shortest):
            low, high = shortest, longest
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if shared(middle) else (low, middle - 1)
            i, j, x, y = both(low)
            places: dict[int, list[int]] = {}
            for start, key in zip(j[::-1].tolist(), y[::-1].tolist(), strict=True):
                places.setdefault(key, []).append(start)
            hit = np.isin(x, y)
            for start, key in zip(i[hit].tolist(), x[hit].tolist(), strict=True):
                if a.used[start] or a.used[start + low - 1]:
                    continue
                held = places[key]
                while held and (b.used[held[-1]] or b.used[held[-1] + low - 1]):
                    held.pop()
                if held and (doc[start : start + low] == item[held[-1] : held[-1] + low]).all():
                    at = held.pop()
                    a.used[start : start + low] = b.used[at : at + low] = True
                    out.append((start, at, low))
            longest = low - 1
        return out


class Items:
    """Word hashes of a slice of the benchmark, and which items have which seed."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.ids, self.hashes = [], []
        seeds, owners = [], []
        for item_id, text in rows:
            h = word_hashes(words(text))
            if len(h) >= MIN_MATCH:
                w = np.unique(windows(h, MIN_MATCH))
                seeds.append(w)
                owners.append(np.full(len(w), len(self.ids)))
                self.ids.append(item_id)
                self.hashes.append(h)
        seed, owner = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (seeds, owners))
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], owner[order].astype(np.int64)

    def sharing(self, doc: np.ndarray) -> np.ndarray:
        """Numbers of the items that share a seed with the document."""
        w = np.unique(windows(doc, MIN_MATCH))
        low = np.searchsorted(self.seed, w, "left")
        hit = low < len(self.seed)
        hit[hit] = self.seed[low[hit]] == w[hit]
        if not hit.any():
            return np.empty(0, np.int64)
        high = np.searchsorted(self.seed, w[hit], "right")
        return np.unique(np.concatenate([self.owner[a:z] for a, z in zip(low[hit], high, strict=True)]))


def slices(benchmark: DataFrame, chars: int = SLICE_CHARS) -> Iterator[tuple[list[tuple[object, str | None]], bool]]:
    """(items, whether it is the last) of slices whose texts have at most ``chars`` characters together (or are one item)."""
    items = benchmark.select("item_id", "text").where("text is not null").dropDuplicates()
    total = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // chars) if total > chars else 1)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        yield [(r["item_id"], r["text"]) for r in items.where(part == k).collect()], k == parts - 1


def contamination(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, item_id, n_tiles, matched, item_words, coverage of each pair that has ``coverage`` or more."""
    found = []
    item_field = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(item_field)
    for rows, last in slices(benchmark, chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def tiled(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                at, out = [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    h = word_hashes(words(t))
                    for k in items.sharing(h):
                        got = tiles(h, items.hashes[k])
                        n, whole = sum(x[2] for x in got), len(items.hashes[k])
                        if n >= coverage * whole:
                            at.append(i)
                            out.append((items.ids[k], len(got), n, whole, n / whole))
                ids = b.column("doc_id").take(pa.array(at, pa.int64()))
                columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5
                kinds = (item_type, pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=NAMES)

        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_field.simpleString()}, n_tiles int, matched int, item_words int, coverage double"
        found.append(_slice_done(docs.select("doc_id", "text").mapInArrow(tiled, schema), shared, last))
    return reduce(DataFrame.unionByName, found)


NAMES = ["doc_id", "item_id", "n_tiles", "matched", "item_words", "coverage"]


def _slice_done(out: DataFrame, shared, last: bool) -> DataFrame:
    """The result of a slice; written, and the slice dropped, if another one follows."""
    if last:
        return out
    out = materialise(out, "slice")
    shared.destroy()
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, chars: int = SLICE_CHARS) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that contain no item; columns as they came."""
    for rows, last in slices(benchmark, chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                keep = []
                for t in b.column("text").to_pylist():
                    h = word_hashes(words(t))
                    keep.append(not any(sum(x[2] for x in tiles(h, items.hashes[k])) >= coverage * len(items.hashes[k]) for k in items.sharing(h)))
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = _slice_done(docs.mapInArrow(clean, docs.schema), shared, last)
    return docs
