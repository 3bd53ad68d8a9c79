"""Operator 4, benchmark decontamination by SimHash windows.

For every benchmark item of L words, every window of L words of every document is a
candidate place; a document of fewer words is one window as a whole.  Items and windows have 64-bit SimHash fingerprints of their weighted word shingles; a
window is compared with the items of its length whose fingerprints lie within ``radius``
bits.  These are found by a multi-index: fingerprints are cut into ``BLOCKS`` blocks, and two
within the radius agree in some block up to ``radius // BLOCKS`` bits, so that looking up one block's value in a
table of all values that close misses none.  Candidates are verified by the exact weighted Jaccard similarity
of the two multisets of shingles.

A shingle weighs the more the fewer of all items hold it; those that fewer than one item in ``_RARE`` holds weigh
alike, so that at most ``_RARE`` times an item's length of shingles weigh less, and their table can be broadcast.  It is
counted by Spark once, over the whole benchmark, so verdicts do not depend on waves.  Windows whose shared weight cannot reach the
threshold are passed over before their fingerprints are made: similarity is at most the weight of the window's
shingles that any item holds, over the lightest item of that length.  That drops no match, and leaves most texts with
one lookup for each word.

Items are taken in waves of ``wave_items``, so what is broadcast is bounded; each wave reads the documents once.
Documents need no shuffle, whatever their sources or copies.

Defined results: null or empty texts, and items without words, match nothing; items of fewer words than a shingle have
one, their whole sequence, and match windows of as many words; of equally similar windows the first
is reported; repeated items and documents each give their own rows; empty tables give no rows.  Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize
from .words import SHINGLE, combine, hash_words, shingles, slices

_U = np.uint64
BLOCKS = 5
_EDGES = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
_REGION = 20_000
_RARE = 1000
_SHIFTS = np.arange(64, dtype=np.uint64)


def _votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each shingle's signed weight for each of the 64 bits."""
    bits = ((hashes[:, None] >> _SHIFTS) & _U(1)).astype(np.int64)
    return (2 * bits - 1) * weights[:, None]


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def simhash(hashes: np.ndarray, weights: np.ndarray) -> int:
    return int(_pack(_votes(hashes, weights).sum(axis=0, keepdims=True))[0])


def weigh(items: int, holding: int) -> int:
    """A whole-number weight, so that sums are exact in any order, of a shingle that ``holding`` of all ``items`` hold."""
    return max(1, round(16 * math.log(1 + min(items / max(holding, 1), _RARE))))


class MultiIndex:
    """Finds all of its fingerprints within ``radius`` bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.tables = []
        for i in range(BLOCKS):
            low, width = _EDGES[i], _EDGES[i + 1] - _EDGES[i]
            near = [sum(1 << b for b in c) for r in range(min(radius // BLOCKS, width) + 1) for c in combinations(range(width), r)]
            value = ((prints >> _U(low)) & _U((1 << width) - 1)).astype(np.int64)
            keys = (value[:, None] ^ np.array(near)[None]).reshape(-1)
            who = np.repeat(np.arange(len(prints)), len(near))
            by = np.argsort(keys, kind="stable")
            self.tables.append((low, width, np.searchsorted(keys[by], np.arange((1 << width) + 1)), who[by]))

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of all pairs within the radius."""
        pairs = []
        for low, width, at, who in self.tables:
            value = ((prints >> _U(low)) & _U((1 << width) - 1)).astype(np.int64)
            n = at[value + 1] - at[value]
            q = np.repeat(np.arange(len(prints)), n)
            nth = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(q * len(self.prints) + who[at[value[q]] + nth])
        pair = np.unique(np.concatenate(pairs))
        q, e = pair // len(self.prints), pair % len(self.prints)
        distance = np.bitwise_count(prints[q] ^ self.prints[e]).astype(np.int64)
        near = distance <= self.radius
        return q[near], e[near], distance[near]


class Items:
    """A wave of benchmark items, ready to be matched.

    ``total`` counts all items; ``common`` has the hashes of shingles that weigh less than the rarest, sorted, and how many items hold each.
    """

    def __init__(self, ids: list, texts: pa.Array, size: int, percent: int, radius: int, total: int, common: tuple[np.ndarray, np.ndarray]):
        self.size, self.percent, self.radius = size, percent, radius
        w = hash_words(texts)
        held = []  # (id, words, shingles)
        for i in range(len(ids)):
            words = w.of(i)
            if len(words):
                held.append((ids[i], len(words), shingles(words, size)))
        self.new = weigh(total, 1)
        self.common, self.common_weight = common[0], np.array([weigh(total, n) for n in common[1].tolist()], np.int64)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s in held)]))
        self.weight = self.weights(self.known)
        # shingle length (short items have shorter ones), words, items of that many words
        self.classes: list[tuple[int, int, list, MultiIndex, list, int]] = []
        for n in sorted({n for _, n, _ in held}):
            some = [(i, s) for i, m, s in held if m == n]
            bags = [self.bag(s) for _, s in some]
            index = MultiIndex(np.array([simhash(s, self.weights(s)) for _, s in some], np.uint64), radius)
            self.classes.append((min(n, size), n, [i for i, _ in some], index, bags, min(sum(b.values()) for b in bags)))

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(hashes), self.new)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.common_weight[at], self.new)

    def bag(self, hashes: np.ndarray) -> Counter:
        """Summed weight of every different shingle."""
        out: Counter = Counter()
        for h, w in zip(hashes.tolist(), self.weights(hashes).tolist(), strict=True):
            out[h] += w
        return out

    def matches(self, words: np.ndarray) -> Iterator[tuple]:
        """(item id, start, words, distance, similarity) of the best window of every item that a text holds."""
        best: dict[tuple[int, int], tuple] = {}
        by_length = {k: combine(words, k) for k in {k for k, *_ in self.classes}}
        for k, hashes in by_length.items():
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[at] == hashes
            if not hit.any():
                continue
            shared = np.where(hit, self.weight[at], 0)
            reach = np.concatenate([[0], np.cumsum(shared)])
            for c, (length, n, ids, index, bags, lightest) in enumerate(self.classes):
                if length != k:
                    continue
                m = min(n - length + 1, len(hashes))  # shingles of a window; a shorter text is one window
                starts = np.flatnonzero(100 * (reach[m:] - reach[:-m]) >= self.percent * lightest)
                for part in _regions(starts, m):
                    a, z = int(part[0]), int(part[-1]) + m
                    sums = np.zeros((z - a + 1, 64), np.int64)
                    np.cumsum(_votes(hashes[a:z], self.weights(hashes[a:z])), axis=0, out=sums[1:])
                    prints = _pack(sums[part - a + m] - sums[part - a])
                    for q, e, d in zip(*index.find(prints), strict=True):
                        s = int(part[q])
                        bag = self.bag(hashes[s : s + m])
                        both = sum(min(x, bags[e][h]) for h, x in bag.items() if h in bags[e])
                        union = sum(bag.values()) + sum(bags[e].values()) - both
                        if 100 * both >= self.percent * union:
                            found = (-both / union, s, m + length - 1, int(d))
                            if (c, e) not in best or found < best[c, e]:
                                best[c, e] = found
        for (c, e), (similarity, s, n, d) in best.items():
            yield self.classes[c][2][e], s, n, d, -similarity


def _regions(starts: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """Groups of neighbouring starts, no group spanning more than about _REGION shingles."""
    if len(starts):
        cut = np.flatnonzero((np.diff(starts) > m) | (np.diff(starts // _REGION) > 0)) + 1
        yield from np.split(starts, cut)


def _item_shingles(size: int):
    """One row for each different shingle of an item, and one null for each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                w = hash_words(b.column(0))
                held = [np.unique(shingles(w.of(i), size)).view(np.int64) for i in range(len(b)) if len(w.of(i))]
                hashes = pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *held])), pa.nulls(len(held), pa.int64())])
                yield pa.RecordBatch.from_arrays([hashes], names=["shingle"])

    return run


def common_shingles(items: DataFrame, size: int) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """How many items have words, and the shingles that weigh less than the rarest with the number of items that hold them."""
    counts = items.select("text").mapInArrow(_item_shingles(size), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    counts = materialize(counts.where("n > 1 or shingle is null"), "item-shingles")
    total = (counts.where("shingle is null").agg(F.max("n")).first()[0]) or 0
    got = counts.where(F.col("shingle").isNotNull() & (F.col("n") > total / _RARE)).select("shingle", "n").toArrow()
    shingle, n = got.column("shingle").to_numpy().view(np.uint64), got.column("n").to_numpy()
    by = np.argsort(shingle)
    return total, (shingle[by], n[by])


def _matcher(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = items.value
        for whole in batches:
            for b in slices(whole, 1):
                w = hash_words(b.column(1))
                rows = [(d, *m) for d in range(len(b)) for m in it.matches(w.of(d))]
                if rows:
                    d, *cols = zip(*rows, strict=True)
                    kinds = (None, pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(d)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                        names=["id", "item_id", "start_word", "n_words", "distance", "similarity"],
                    )

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    size: int = SHINGLE,
    percent: int = 75,
    radius: int = 19,
    wave_items: int = 4096,
) -> DataFrame:
    """(id, item_id, start_word, n_words, distance, similarity): every item that a document holds, at its best window."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    item_type = T.StringType() if isinstance(benchmark.schema[item_column].dataType, T.StringType) else T.LongType()
    items = benchmark.where(F.col(item_text_column).isNotNull()).select(F.col(item_column).cast(item_type).alias("item"), F.col(item_text_column).alias("text"))
    # waves by a hash of the item, as many as keep each below wave_items
    waves = max(1, -(-items.count() * 5 // (4 * wave_items)))
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("item_id", item_type), T.StructField("start_word", T.LongType())]
        + [T.StructField("n_words", T.LongType()), T.StructField("distance", T.LongType()), T.StructField("similarity", T.DoubleType())]
    )
    total, common = common_shingles(items, size)
    found = None
    for wave in range(waves):
        got = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(waves)) == wave).orderBy("item", "text").toArrow()
        held = Items(got.column("item").to_pylist(), got.column("text"), size, percent, radius, total, common)
        if held.classes:
            part = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(held)), schema)
            found = part if found is None else found.unionByName(part)
    found = found if found is not None else spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_column)
