"""Operator 1, LM scoring with a log-frequency Bloom filter.

Counts of all n-grams of the training documents are quantised on a log scale
and stored in a Bloom filter: an n-gram of level q is inserted q times, as
(n-gram, 1) .. (n-gram, q).  A scorer reads a level back by probing 1, 2, ...
until one is absent.  The probabilities are interpolated in Witten-Bell's way:

    P(w | v) = (low(v w) + t(v) * P(w)) / (high(v) + t(v)),  t(v) = high(v) ** g
    P(w) = (low(w) + 1) / (sum of low over all words + V + 1)

low() and high() are the least and the greatest count of an n-gram's level, so that the
probabilities of all words, and one for all unknown ones, add up to 1 in P(w) and to 1 at most in P(w | v).
t(v) stands for the number of different successors of v; g is set so that these add up to
the number of different n-grams in the corpus.

How it is laid out, whatever the size of the corpus:

* every task counts its own n-grams in numpy and deals them out by the top
  bits of their hash, so one n-gram meets in one bucket whatever its
  frequency (a hot word is one entry for each task);
* buckets are as many as the corpus needs, so that each stays small, and each
  makes its own shard of the filter, of ``bits_per_entry`` or more for each entry;
* what the filter answers for the frequent n-grams (``hot_count`` or more; a higher count where that would not
  fit ``max_filter_bytes``) is broadcast: their keys, and the level that their own shard reads for each.  Any other n-gram is asked
  where its shard is: texts are put into chunks, each chunk's distinct n-grams travel to their shards, and their levels travel
  back.  Both ways give what the shard reads, false hits included, so scores do not depend on what is broadcast.  Broadcasting the
  whole filter would need about a byte for each different n-gram, which grows with the corpus;
* buckets are 2 million at most: beyond some 25 TB of text they grow with it;
* exact unigram counts, which the base score needs, stay a distributed table.
  Words above a frequency threshold (``hot_words`` entries at most) are
  broadcast; every other token is joined to the table by Spark.

Defined results: a null or empty text is a document of one token, its end; a
repeated row is scored as often as it appears; with no training documents all
counts are 0, V = 0 and N = 0, so every token has probability 1 / 1.  Words are
of any length; texts are never shortened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize
from .words import combine, give_back, hash_words, mix64, slices

_U = np.uint64
#: Stands for a text's start and its end.
END = _U(0x51AFD7ED558CCD6D)
_LEVELS = 128
_PROBES = 4
_FLUSH = 6_000_000
_BUCKET_BYTES = 24 << 20
_MOST_BITS = 21
_CHUNK_BYTES = 4 << 20
_ASK_BYTES = 2 << 20

_COUNT_SCHEMA = "bucket int, n int, keys binary, counts binary"
_ASK_SCHEMA = "bucket int, chunk long, data binary"
#: Bytes of a broadcast n-gram: its key and its level.
_HOT_BYTES = 9
_SHARD_SCHEMA = "bucket int, bits binary, histogram binary, read binary, hot_keys binary, hot_levels binary, words binary, word_counts binary, tokens long"


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """Level of a count: 1 + floor(log_base(count)), 0 for none."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9), 0).astype(np.int64)


def level_counts(base: float, top: int = _LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest count of every level."""
    edges = base ** np.arange(top + 1)
    low = np.ceil(edges[:-1] - 1e-9)
    return np.concatenate([[0.0], low]), np.concatenate([[0.0], np.maximum(low, np.ceil(edges[1:] - 1e-9) - 1)])


def _split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (top bits) and the 32 bits below them, which identify an n-gram within its bucket."""
    return (h >> _U(64 - bits)).astype(np.int64), (h << _U(bits)) >> _U(32)


def _pack(keys: np.ndarray) -> bytes:
    """Keys of 32 or 64 bits by bytes, highest first: sorted ones compress well."""
    return keys.view(np.uint8).reshape(-1, keys.itemsize)[:, ::-1].T.tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1)[::-1].T).view(f"<u{width}").reshape(-1).astype(np.uint64)


def _hashes(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The place and the step of the bits of (n-gram, level)."""
    h = mix64(key ^ _U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return h, (h >> _U(33)) | _U(1)


def _emit(parts: dict[int, tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    cols: list[list] = [[], [], [], []]
    for n, (u, c) in parts.items():
        bucket, key = _split(u, bits)
        key = u if n == 1 else key.astype(np.uint32)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        for s, e in zip(at, [*at[1:], len(u)], strict=True):
            for col, x in zip(cols, (int(bucket[s]), n, _pack(key[s:e]), c[s:e].astype(np.uint32).tobytes()), strict=True):
                col.append(x)
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["bucket", "n", "keys", "counts"])


def _fold(chunks: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their summed counts."""
    if all(c is None for _, c in chunks):
        return np.unique(np.concatenate([h for h, _ in chunks]), return_counts=True)
    h = np.concatenate([h for h, _ in chunks])
    c = np.concatenate([np.ones(len(h), np.int64) if c is None else c for h, c in chunks])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(c, at)


def _counter(order: int, bits: int):
    """Counts the n-grams of the texts of a task; what it holds is bounded by _FLUSH entries an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {n: [] for n in range(1, order + 1)}
        size = 0
        for batch in (part for whole in batches for part in slices(whole, 0)):
            w = hash_words(batch.column(0))
            # each text becomes START word ... word END, and no n-gram crosses texts
            n_docs = len(w.bounds) - 1
            seq = np.insert(w.hashes, w.bounds[1:], END)
            ends = w.bounds[1:] + np.arange(1, n_docs + 1)
            if not len(seq):
                continue
            held[1].append((seq, None))
            for n in range(2, order + 1):
                # START is the same mark as END, so the text before supplies it
                grams = combine(np.concatenate([[END], seq]), n)
                held[n].append((grams if n == 2 else _inside(grams, ends, n), None))
            size += len(seq)
            if size >= _FLUSH:
                held = {n: [_fold(x)] for n, x in held.items() if x}
                size = max(len(x[0][0]) for x in held.values())
                if size >= _FLUSH // 2:
                    yield _emit({n: x[0] for n, x in held.items()}, bits)
                    held, size = {n: [] for n in range(1, order + 1)}, 0
        if any(held.values()):
            yield _emit({n: _fold(x) for n, x in held.items() if x}, bits)

    return run


def _inside(grams: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """n-grams (n > 2) that have at most their first word, START, in the text before."""
    keep = np.ones(len(grams), bool)
    for j in range(1, n - 1):
        at = ends[:-1] + j - n + 1
        keep[at[(at >= 0) & (at < len(grams))]] = False
    return grams[keep]


def _bloom(key: np.ndarray, level: np.ndarray, bits_per_entry: int) -> bytes:
    """The bits of a shard that holds each key at the levels 1 .. level."""
    size = 64
    while size < int(level.sum()) * bits_per_entry:
        size *= 2
    field = np.zeros(size, dtype=bool)
    j = 1
    while len(key):
        h, step = _hashes(key, j)
        for i in range(_PROBES):
            field[((h + step * _U(i)) & _U(size - 1)).astype(np.int64)] = True
        j += 1
        keep = level >= j
        key, level = key[keep], level[keep]
    return np.packbits(field, bitorder="little").tobytes()


def _shard(order: int, base: float, bits: int, bits_per_entry: int, hot_level: int):
    """Makes a bucket's shard of the filter; keeps what it reads for its frequent n-grams, and the exact counts of its words."""

    def run(table: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        for n, keys, counts in zip(*(table.column(c).to_pylist() for c in ("n", "keys", "counts")), strict=True):
            got.setdefault(n, []).append((_unpack(keys, 8 if n == 1 else 4), np.frombuffer(counts, np.uint32).astype(np.int64)))
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words, word_counts = _fold(got[1]) if 1 in got else none
        folded = [(_split(words, bits)[1], word_counts), *(_fold(got[n]) if n in got else none for n in range(2, order + 1))]
        level_of = [levels(c, base) for _, c in folded]
        key, level = np.concatenate([k for k, _ in folded]), np.concatenate(level_of)
        field = _bloom(key, level, bits_per_entry)
        key = np.unique(key[level >= hot_level])
        read = CountFilter([(0, field)], 0).levels_of_key(key)
        values = {
            "bucket": table.column("bucket")[0].as_py(),
            "bits": field,
            "read": np.bincount(read, minlength=_LEVELS).astype(np.int64).tobytes(),
            "histogram": np.stack([np.bincount(x, minlength=_LEVELS) for x in level_of]).astype(np.int64).tobytes(),
            "hot_keys": _pack(key.astype(np.uint32)),
            "hot_levels": read.astype(np.uint8).tobytes(),
            "words": _pack(words),
            "word_counts": word_counts.tobytes(),
            "tokens": int(word_counts.sum()),
        }
        kinds = {"bucket": pa.int32(), "tokens": pa.int64()}
        return pa.table({c: pa.array([x], kinds.get(c, pa.binary())) for c, x in values.items()})

    return run


def _hot_parts(hot_level: int, bits: int):
    """Bucket and key as one number, and the level, of the n-grams that their shards read at ``hot_level`` or more; a row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                level = [np.frombuffer(x, np.uint8) for x in b.column(2).to_pylist()]
                names = [_unpack(keys, 4) | _U(bucket << 32) for bucket, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                level, names = np.concatenate(level), np.concatenate(names)
                hot = level >= hot_level
                yield pa.RecordBatch.from_arrays([pa.array([names[hot].tobytes()], pa.binary()), pa.array([level[hot].tobytes()], pa.binary())], names=["names", "levels"])

    return run


class HotLevels:
    """What the shards read for the frequent n-grams."""

    def __init__(self, names: np.ndarray, level: np.ndarray, bits: int):
        by = np.argsort(names)
        self.bits, self.names, self.level = bits, names[by], level[by]

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The levels of n-grams; 0 for those that are to be asked."""
        out = np.zeros(len(h), np.uint8)
        if len(self.names):
            name = h >> _U(32 - self.bits)
            at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            hit = self.names[at] == name
            out[hit] = self.level[at[hit]]
        return out


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(words, 8).view(np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["word", "n"])


class CountFilter:
    """The log-frequency filter, or some of its shards; levels() reads quantised counts by probing."""

    def __init__(self, shards: list[tuple[int, bytes]], bits: int):
        self.bits = bits
        self.size = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.uint64)
        shards = sorted(shards)
        at = 0
        for b, field in shards:
            self.size[b], self.at[b] = len(field) * 8, at * 8
            at += len(field)
        self.field = np.frombuffer(b"".join(f for _, f in shards) or bytes(8), np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        bucket, key = _split(h, self.bits)
        return self._probe(key, self.size[bucket], self.at[bucket])

    def levels_of_key(self, key: np.ndarray) -> np.ndarray:
        """Levels in the first shard."""
        return self._probe(key, np.full(len(key), self.size[0]), np.full(len(key), self.at[0]))

    def _probe(self, key: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        level = np.zeros(len(key), np.int64)
        left = np.flatnonzero(size)
        j = 1
        while len(left) and j < _LEVELS:
            h, step = _hashes(key[left], j)
            for i in range(_PROBES):
                spot = ((h + step * _U(i)) & (size[left] - _U(1))) + at[left]
                hit = (self.field[(spot >> _U(3)).astype(np.int64)] >> (spot & _U(7)).astype(np.uint8)) & np.uint8(1) == 1
                left, h, step = left[hit], h[hit], step[hit]
            level[left] = j
            j += 1
        return level


class ChunkGrams:
    """A chunk's tokens, its distinct n-grams, and which of these the broadcast levels leave to be asked.

    The same texts give the same n-grams in the same order, so that the answers need no keys.
    """

    def __init__(self, texts: pa.Array, order: int, hot: HotLevels):
        w = hash_words(texts)
        self.docs = len(w.bounds) - 1
        self.tokens = np.insert(w.hashes, w.bounds[1:], END)
        self.bounds = w.bounds + np.arange(self.docs + 1)
        whole = np.concatenate([[END], self.tokens])
        self.codes, self.distinct = zip(*(pd.factorize(self.tokens if n == 1 else combine(whole, n)) for n in range(1, order + 1)), strict=True)
        every = np.concatenate(self.distinct)
        self.level = hot.levels(every)
        self.ask = np.flatnonzero(self.level == 0)
        bucket, key = _split(every[self.ask], hot.bits)
        by = np.argsort(bucket.astype(np.uint16 if hot.bits <= 16 else np.uint32), kind="stable")
        self.ask, self.bucket, self.key = self.ask[by], bucket[by], key[by].astype(np.uint32)

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, keys) for every bucket that is asked, in order of the buckets."""
        at = np.flatnonzero(np.diff(self.bucket, prepend=-1)).tolist()
        for s, e in zip(at, [*at[1:], len(self.key)]):  # nothing asked: no bucket
            yield int(self.bucket[s]), self.key[s:e].tobytes()

    def answered(self, level: np.ndarray) -> list[np.ndarray]:
        """Levels of the n-grams of each order, one for each place, given those of ``questions`` in order."""
        self.level[self.ask] = level
        ends = np.cumsum([len(d) for d in self.distinct])
        return [self.level[e - len(d) : e][c] for c, d, e in zip(self.codes, self.distinct, ends, strict=True)]


def _chunker(chunk_bytes: int):
    """One row for each slice of rows, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, most=chunk_bytes):
                if part.num_rows:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    return run


def _unchunk(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _asker(order: int, hot):
    """What each chunk asks, one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = _unchunk(data.as_py())
                asked = list(ChunkGrams(part.column(part.num_columns - 1), order, hot.value).questions())
                if asked:
                    bucket, keys = zip(*asked, strict=True)
                    arrays = [pa.array(bucket, pa.int32()), pa.array([chunk] * len(bucket), pa.int64()), pa.array(keys, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "chunk", "data"])
                give_back()

    return run


def _answer(f: CountFilter | None, asked: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    keys = [np.frombuffer(data, np.uint32) for _, _, data in asked]
    key = np.concatenate(keys).astype(np.uint64)
    level = (np.zeros(len(key)) if f is None else f.levels_of_key(key)).astype(np.uint8)
    data = [x.tobytes() for x in np.split(level, np.cumsum([len(k) for k in keys])[:-1])]
    bucket, chunk, _ = zip(*asked, strict=True)
    arrays = [pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "chunk", "data"])


def _answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of what was asked; a bucket's shard, if it has one, comes before its questions."""
    at, f, asked, size = None, None, [], 0
    for batch in batches:
        for bucket, chunk, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            b, c, d = bucket.as_py(), chunk.as_py(), data.as_py()
            if asked and (b != at or size >= _ASK_BYTES):
                yield _answer(f, asked)
                asked, size = [], 0
            if b != at:
                at, f = b, None
            if c < 0:
                f = CountFilter([(0, d)], 0)
            else:
                asked.append((b, c, d))
                size += len(d)
        give_back()
    if asked:
        yield _answer(f, asked)


def _scorer(hot, words, model: Model):
    """Scores chunks; a chunk comes before its answers, and these in order of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, level = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if chunk is not None:
                part = _unchunk(chunk)
                grams = ChunkGrams(part.column(part.num_columns - 1), model.order, hot.value)
                yield _scores(part, grams, np.frombuffer(b"".join(level), np.uint8), *words.value, model)

        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                data = batch.column(2)[i].as_py()
                if bucket < 0:
                    yield from done()
                    chunk, level = data, []
                else:
                    level.append(data)
            give_back()
        yield from done()

    return run


@dataclass
class Model:
    """What scoring needs besides the filter."""

    order: int
    base: float
    growth: list[float]
    tokens: int
    vocabulary: int
    mass: float  # the sum of the least counts of all words' levels

    def probabilities(self, level: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
        """P of every token, from the levels of the n-grams (of each order, by where they begin in START + tokens)."""
        low, high = level_counts(self.base)
        prob = (low[level[0]] + 1) / (self.mass + self.vocabulary + 1)
        for n in range(2, self.order + 1):
            if n == 2:
                # the token before a text's first is its START, the same mark as END
                before = np.concatenate([level[0][bounds[1] - 1 : bounds[1]], level[0][:-1]])
                c, h, ok = low[level[1]], high[before], np.ones(len(prob), bool)
            else:
                ok = np.arange(len(prob)) - np.repeat(bounds[:-1], np.diff(bounds)) >= n - 2
                at = np.flatnonzero(ok)
                c, h = np.zeros(len(prob)), np.zeros(len(prob))
                c[at], h[at] = low[level[n - 1][at + 2 - n]], high[level[n - 2][at + 2 - n]]
            # a false hit can't make more than certainty, and none follows what was never seen
            t = np.maximum(h, 1) ** self.growth[n - 2]
            prob = np.where(ok & (h > 0), (np.minimum(c, h) + t * prob) / (h + t), prob)
        return prob


def _scores(part: pa.RecordBatch, grams: ChunkGrams, answers: np.ndarray, hot_words: np.ndarray, hot_counts: np.ndarray, model: Model) -> pa.RecordBatch:
    """Scores texts; tokens outside the hot words leave as a list of hashes, to be joined."""
    bounds = grams.bounds
    score = np.add.reduceat(np.log10(model.probabilities(grams.answered(answers), bounds)), bounds[:-1])
    u, back = grams.distinct[0], grams.codes[0]
    at = np.minimum(np.searchsorted(hot_words, u), max(len(hot_words) - 1, 0))
    is_hot = hot_words[at] == u if len(hot_words) else np.zeros(len(u), bool)
    exact = np.where(is_hot, hot_counts[at] if len(hot_words) else 0, 0)
    logs = np.log10((exact + 1) / float(model.tokens + model.vocabulary + 1))
    hot_token = is_hot[back]
    base = np.add.reduceat(np.where(hot_token, logs[back], 0.0), bounds[:-1])
    known = np.add.reduceat(hot_token.astype(np.int64), bounds[:-1])
    cold = np.flatnonzero(~hot_token)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(cold, bounds).astype(np.int32)), pa.array(grams.tokens[cold].view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [*part.columns[:-1], pa.array(np.diff(bounds)), pa.array(known), pa.array(base), pa.array(score), lists],
        names=[*part.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "cold"],
    )


def successor_growth(histories: np.ndarray, distinct: int, stands_for: np.ndarray) -> float:
    """g in (0, 1) for which the histories' count ** g add up to the number of distinct n-grams."""
    n, c = histories[1:], stands_for[1 : len(histories)]
    low, high = 0.0, 1.0
    for _ in range(50):
        g = (low + high) / 2
        low, high = (g, high) if float((n * c**g).sum()) < distinct else (low, g)
    return min(max((low + high) / 2, 0.05), 0.98)


def score_documents(
    docs: DataFrame,
    train: Column,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    order: int = 2,
    quantisation: float = 1.5,
    bits_per_entry: int = 8,
    hot_count: int = 8,
    max_filter_bytes: int = 64 << 20,
    hot_words: int = 1_000_000,
) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row; see the module's text.

    Returns the id, ``is_train``, n_tokens, n_known (tokens that training has),
    train_tokens (N), vocabulary (V), base_score (exact add-one unigrams) and
    score (the n-gram model), both log10 probabilities of the whole text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(train, F.lit(False)).alias("is_train"), F.col(text_column).alias("text"))
    learn = rows.where("is_train").select("text")

    # as many buckets as keep each within a few MB of counts, whatever the corpus; chunks grow where buckets are very many
    size = learn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size, 1) / _BUCKET_BYTES * order)), 4), _MOST_BITS)
    chunk_bytes = _CHUNK_BYTES << min(max(bits - 14, 0), 4)
    low, high = level_counts(quantisation)
    hot_level = int(levels(np.array([hot_count]), quantisation)[0])
    counted = learn.mapInArrow(_counter(order, bits), _COUNT_SCHEMA)
    shards = materialize(
        counted.groupBy("bucket").applyInArrow(_shard(order, quantisation, bits, bits_per_entry, hot_level), _SHARD_SCHEMA), "lm-shards"
    )

    histogram, read = np.zeros((order, _LEVELS), np.int64), np.zeros(_LEVELS, np.int64)
    tokens = 0
    for r in shards.select("histogram", "read", "tokens").toLocalIterator():
        histogram += np.frombuffer(bytes(r.histogram), np.int64).reshape(order, _LEVELS)
        read += np.frombuffer(bytes(r.read), np.int64)
        tokens += r.tokens
    vocabulary = int(histogram[0].sum())
    growth = [successor_growth(histogram[n - 2], int(histogram[n - 1].sum()), high) for n in range(2, order + 1)]
    model = Model(order, quantisation, growth, tokens, vocabulary, float((histogram[0] * low[:_LEVELS]).sum()))

    frequent = np.cumsum(read[::-1])[::-1]  # by the level read
    while hot_level < _LEVELS - 1 and frequent[hot_level] * _HOT_BYTES > max_filter_bytes:
        hot_level += 1
    parts = shards.select("bucket", "hot_keys", "hot_levels").mapInArrow(_hot_parts(hot_level, bits), "names binary, levels binary").collect()
    names, known = (np.frombuffer(b"".join(bytes(r[i]) for r in parts), kind) for i, kind in enumerate((np.uint64, np.uint8)))
    hot = spark.sparkContext.broadcast(HotLevels(names, known, bits))

    above = np.cumsum(histogram[0][::-1])[::-1]
    first_hot = int(np.argmax(above <= hot_words))
    threshold = math.ceil(quantisation ** (first_hot - 1) - 1e-9) if first_hot else 0
    words = shards.select("words", "word_counts").mapInArrow(_words_of, "word long, n long")
    got = words.where(F.col("n") >= threshold).toArrow()
    hot_w, hot_n = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy()
    by = np.argsort(hot_w)
    hot_exact = spark.sparkContext.broadcast((hot_w[by], hot_n[by]))

    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("is_train", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
        + [T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("cold", T.ArrayType(T.LongType()))]
    )
    chunks = materialize(rows.mapInArrow(_chunker(chunk_bytes), "data binary").withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")
    asked = chunks.select("chunk", "data").mapInArrow(_asker(order, hot), _ASK_SCHEMA)
    asked = shards.select("bucket", F.lit(-1).cast("long").alias("chunk"), F.col("bits").alias("data")).unionByName(asked)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answerer, _ASK_SCHEMA)
    both = chunks.select(F.lit(-1).alias("bucket"), "chunk", "data").unionByName(answers)
    scored = both.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_scorer(hot, hot_exact, model), schema)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    total = F.lit(float(tokens + vocabulary + 1))
    cold = (
        scored.select("row", F.explode("cold").alias("word"))
        .groupBy("row", "word")
        .agg(F.count("*").alias("tf"))
        .join(words.where(F.col("n") < threshold), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 1) / total)).alias("cold_score"),
            F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("cold_known"),
        )
    )
    return scored.drop("cold").join(cold, "row", "left").select(
        F.col("id").alias(id_column),
        "is_train",
        "n_tokens",
        (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.lit(vocabulary).cast("long").alias("vocabulary"),
        (F.col("base_score") + F.coalesce("cold_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
