"""Vectorised word and shingle hashing over Arrow text columns.

A word is a maximal run of bytes outside space and ``\\x09-\\x0D``; ASCII A-Z
are folded to lower case.  Working on the UTF-8 bytes of a whole Arrow batch
keeps Python objects out of the inner loop: word boundaries, word hashes and
shingle hashes are each a handful of numpy passes.

Hashes are 64 bit: a polynomial in a random byte table, finished with a
bijective mixer.  They stand for the words wherever words are compared.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_CHUNK = 1 << 18
_U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TABLE[65:91] = _TABLE[97:123]
_COMBINE = [int(x) | 1 for x in _rng.integers(1, 1 << 62, 64, dtype=np.uint64)]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * _U(step)
        have += take
        step = step * step & _MASK
    return out


_pow = powers(_P, _CHUNK + 1)
_inv = powers(_PINV, _CHUNK + 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= _CHUNK:
        return _pow, _inv
    return powers(_P, n + 1), powers(_PINV, n + 1)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs end far apart."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@dataclass
class Words:
    """Word hashes of a batch, and where in its bytes the words are; document d owns hashes[bounds[d]:bounds[d + 1]]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def of(self, d: int) -> np.ndarray:
        return self.hashes[self.bounds[d] : self.bounds[d + 1]]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library

    def _trim(_: int) -> int:
        return 0


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, *text_at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in the columns ``text_at`` (or one row, if it is longer).

    Spark's batches count rows, not bytes; working on slices bounds what a task holds besides the batch
    itself.  What Arrow and numpy have freed goes back to the system at each batch's end.
    """
    size = np.zeros(batch.num_rows, np.int64)
    for i in text_at:
        size += np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), dtype=np.int64)
    part = (np.cumsum(size) - size) // most
    cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows).tolist()
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, z - a)
    give_back()


def hash_words(column: pa.Array | pa.ChunkedArray) -> Words:
    """Hashes of all words of a string column, in order."""
    data, offsets = text_bytes(column)
    total = len(data)
    starts_of_docs = np.unique(offsets[:-1])
    hashes, firsts, lasts = [], [], []
    a = 0
    while a < total:
        b = min(total, a + _CHUNK)
        if b < total:  # end on white space or a document's end, never inside a word
            nxt = starts_of_docs[np.searchsorted(starts_of_docs, b)] if b <= starts_of_docs[-1] else total
            while b < nxt:
                gap = np.flatnonzero(~_IS_WORD[data[b : min(nxt, b + 4096)]])
                if len(gap):
                    b += int(gap[0])
                    break
                b = min(nxt, b + 4096)
        part = data[a:b]
        word = _IS_WORD[part]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        cut = starts_of_docs[np.searchsorted(starts_of_docs, a) : np.searchsorted(starts_of_docs, b)] - a
        begin[cut] = word[cut]
        end = word.copy()
        end[:-1] &= ~word[1:]
        last = cut[cut > 0] - 1
        end[last] = word[last]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if len(s):
            power, inverse = _tables(b - a)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_TABLE[part] * power[: b - a], out=sums[1:])
            hashes.append(mix64((sums[e] - sums[s]) * inverse[s]))
            firsts.append(s + a)
            lasts.append(e + a)
        a = b
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    starts = np.concatenate(firsts)
    return Words(np.concatenate(hashes), np.searchsorted(starts, offsets), starts, np.concatenate(lasts))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n neighbouring word hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, (n * 0x2545F4914F6CDD1D) & _MASK, dtype=np.uint64)
    for j in range(n):
        out += hashes[j : len(hashes) - n + 1 + j] * _U(_COMBINE[j % 64] + 2 * (j // 64))
    return mix64(out)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Shingle hashes of one document in order: all runs of ``size`` words, or the whole if shorter."""
    return combine(words, size) if len(words) >= size else combine(words, len(words)) if len(words) else words
