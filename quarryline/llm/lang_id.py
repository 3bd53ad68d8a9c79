"""Operator 3, language identification by a byte convolutional network.

Texts are cut into windows of ``WINDOW`` bytes (each sees a few bytes of the next); a window
passes through a byte embedding, filters of several widths, a maximum over its positions, and a softmax.
All of it is numpy: a task convolves batches of windows as one matrix product, the
widths being zero-padded to the longest.  A document's log probabilities are the mean over all its
windows, weighted by their numbers of letter bytes; no part of a text is left out.

The network is trained on the driver, on a bounded sample: about ``per_language`` documents of
each language and two windows of each.  Every language is learned, in whatever script; with more than
``_FULL_SAMPLES`` languages the sample of each is smaller, ``_LEAST_SAMPLE`` at least, so that the driver's work stays bounded.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn
from; with one language only, every text with a letter is of that language with score 1.  Equal probabilities go to the language first in order.  Repeated
rows are predicted alike; no other columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import unused, with_text
from .sampling import labelled_sample
from .words import slices, text_bytes

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
_FILTERS, _DIM, _WIDE = 12, 8, max(WIDTHS)
_FULL_SAMPLES, _LEAST_SAMPLE = 64, 50
_LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER_BYTE = np.zeros(256, np.float32)
_LETTER_BYTE[97:123] = 1
_LETTER_BYTE[128:] = 0.5


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as rows of WINDOW + widest - 1 bytes, zero where a text has ended, and each one's text."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + nth * WINDOW
    at = start[:, None] + np.arange(WINDOW + _WIDE - 1)
    inside = at < offsets[owner + 1][:, None]
    return np.where(inside, _FOLD[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else 0, 0).astype(np.uint8), owner


class ByteCnn:
    """The network; parameters are float32 arrays."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, _DIM)).astype(np.float32)
        self.filters = np.zeros((_WIDE * _DIM, _FILTERS * len(WIDTHS)), np.float32)
        self.mask = np.zeros_like(self.filters)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * _DIM, i * _FILTERS : (i + 1) * _FILTERS] = 1
        self.filters = (rng.normal(0, 0.35, self.filters.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.filters.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.filters.shape[1], len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _patches(self, rows: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(self.embed[rows])
        n = len(rows)
        view = np.lib.stride_tricks.as_strided(x, (n, WINDOW, _WIDE * _DIM), (x.strides[0], x.strides[1], x.strides[2]))
        return view.reshape(n * WINDOW, _WIDE * _DIM)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Maxima of all filters over the positions of each window, and, if asked for, their positions."""
        conv = (self._patches(rows) @ self.filters).reshape(len(rows), WINDOW, -1)
        top = conv.max(axis=1) + self.bias
        return (np.maximum(top, 0), conv.argmax(axis=1)) if where else np.maximum(top, 0)

    def log_probs(self, rows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = []
        for s in range(0, len(rows), batch):
            z = self.pooled(rows[s : s + batch]) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def fit(self, rows: np.ndarray, target: np.ndarray, epochs: int = 12, least_steps: int = 700, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the cross-entropy; a pooled maximum passes its gradient to its own position alone.

        Small samples are gone through more often, so that there are at least about ``least_steps`` steps.
        """
        rng = np.random.default_rng(seed)
        batch = min(128, max(16, len(rows) // 16))
        epochs = max(epochs, least_steps * batch // len(rows))
        params = [self.embed, self.filters, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), batch):
                at = order[s : s + batch]
                x, y = rows[at], target[at]
                top, place = self.pooled(x, where=True)
                z = top @ self.out + self.out_bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                d_top = (p @ self.out.T) * (top > 0)
                near = place[:, :, None] + np.arange(_WIDE)  # window, filter, byte of the patch
                seen = x[np.arange(len(x))[:, None, None], near]
                patch = self.embed[seen].reshape(*place.shape, -1)
                d_filters = np.einsum("nf,nfk->kf", d_top, patch) * self.mask
                d_patch = (d_top[:, :, None] * self.filters.T[None]).reshape(-1, _DIM)
                d_embed = np.zeros_like(self.embed)
                np.add.at(d_embed, seen.reshape(-1), d_patch)
                grads = [d_embed, d_filters, d_top.sum(axis=0), top.T @ p, p.sum(axis=0)]
                step += 1
                lr = rate * (1 - epoch / epochs)
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, *, id_column: str, text_column: str, lang_column: str, per_language: int = 2500) -> ByteCnn | None:
    """A network for the languages of ``docs``, from about per_language documents of each; None without any."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).where("lang is not null and text rlike '\\\\p{L}'")
    languages = rows.select("lang").distinct().count()
    per_language = min(per_language, max(per_language * _FULL_SAMPLES // max(languages, 1), _LEAST_SAMPLE))
    some = labelled_sample(rows, "lang", "id", per_language, None)
    spread = F.greatest(F.length("text") - WINDOW, F.lit(1))
    spots = [F.substr("text", (F.pmod(F.xxhash64("id", F.lit(i)), spread) + 1).cast("int"), F.lit(WINDOW + _WIDE)) for i in range(2)]
    got = some.select("id", "lang", F.array(*spots).alias("w")).orderBy("id", "lang").toArrow()
    lang = got.column("lang").to_pylist()
    labels = sorted(set(lang))
    if not labels:
        return None
    texts = pa.array([x for w in got.column("w").to_pylist() for x in w])
    data, offsets = text_bytes(texts)
    # one window of each substring: its first WINDOW bytes
    rows_of, owner = windows(data, offsets)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    target = np.searchsorted(np.array(labels, object), np.array(lang, object))[owner[firsts] // 2]
    net = ByteCnn(labels)
    if len(labels) > 1:
        net.fit(rows_of[firsts], target)
    return net


def _predict(model, at: int, drop: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteCnn | None = model.value
        for whole in batches:
            for b in slices(whole, at):
                texts = b.column(at)
                known = np.array([net is not None and x is not None and _LETTER.search(x) is not None for x in texts.to_pylist()])
                pred, score = np.full(len(b), UNDETERMINED, object), np.zeros(len(b))
                if known.any():
                    data, offsets = text_bytes(texts)
                    total = np.zeros((len(b), len(net.labels)))
                    weight = np.zeros(len(b))
                    # windows of a few MB at a time, whatever the length of a text
                    lengths = np.diff(offsets)
                    step = 4096 * WINDOW
                    for d0, d1, a, z in _pieces(offsets, step):
                        part = np.clip(offsets[d0 : d1 + 1], a, z) - a
                        rows, owner = windows(data[a : min(z + _WIDE - 1, int(offsets[d1]))], part)
                        lp = net.log_probs(rows)
                        w = _LETTER_BYTE[rows[:, :WINDOW]].sum(axis=1) + 1e-3
                        np.add.at(total, owner + d0, lp * w[:, None])
                        np.add.at(weight, owner + d0, w)
                    able = np.flatnonzero(known & (lengths > 0))
                    mean = total[able] / weight[able][:, None]
                    mean -= mean.max(axis=1, keepdims=True)
                    p = np.exp(mean)
                    p /= p.sum(axis=1, keepdims=True)
                    pred[able] = np.array(net.labels, object)[p.argmax(axis=1)]
                    score[able] = p.max(axis=1)
                kept = b.columns[:-1] if drop else b.columns
                arrays = [*kept, pa.array(pred.tolist(), pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    return run


def _pieces(offsets: np.ndarray, step: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts the texts' bytes into pieces [a, z) of texts d0 .. d1 - 1; only texts longer than ``step`` are cut inside."""
    d, n = 0, len(offsets) - 1
    while d < n:
        if offsets[d + 1] - offsets[d] > step:
            for a in range(int(offsets[d]), int(offsets[d + 1]), step):
                yield d, d + 1, a, min(a + step, int(offsets[d + 1]))
            d += 1
            continue
        e = d + 1
        while e < n and offsets[e + 1] - offsets[d] <= step:
            e += 1
        yield d, e, int(offsets[d]), int(offsets[e])
        d = e


def identify(
    docs: DataFrame,
    model: ByteCnn | None,
    *,
    text_column: str = "text",
    keep: list[str | Column] | None = None,
    pred_column: str = "lang_pred",
    score_column: str = "score",
) -> DataFrame:
    """The ``keep`` columns (default: all) with the predicted language and its probability, for every row; their names get underscores where they are kept already."""
    rows = docs if keep is None else with_text(docs, keep, text_column)
    at = docs.columns.index(text_column) if keep is None else len(rows.columns) - 1
    fields = rows.schema.fields if keep is None else rows.schema.fields[:-1]
    kept = docs if keep is None else docs.select(*keep)
    pred, score = unused(pred_column, kept), unused(score_column, kept)
    schema = T.StructType([*fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    named = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), at, keep is not None), named).toDF(*schema.names)
