"""Operator 6, quality classification by compression with two dictionaries.

One zstandard dictionary is built from texts labelled good and one from texts
labelled bad.  A text is cut into chunks of ``CHUNK`` bytes, each chunk is compressed with either
dictionary, and the sizes are summed over the whole text.  The normalised difference

    (size with the good one - size with the bad one) / the larger

says which kind of text it is closer to.  A logistic regression on labelled texts that the
dictionaries have not seen turns it, with the spread of the chunks' differences and the text's own
compressibility, into a calibrated probability.

Dictionaries are built on the driver from a bounded sample: ``per_label`` texts of each label give ``CHUNKS_EACH``
chunks each, from anywhere in the text.  As many others give the calibration.  Scoring reads every byte of every text.

Defined results: null and empty texts have no sizes and get the score of neutral features; with labels of one kind only, or
none, all texts get the smoothed rate of label 1 (0.5 without labels); labels other than 0 and 1 are not learned from; a
document labelled twice is learned from twice; repeated rows score alike; no other columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic
from .filters import unused, with_text
from .sampling import labelled_sample, labelled_texts, prior_shift
from .words import slices, text_bytes

CHUNK = 1024
CHUNKS_EACH = 6
_LEVEL = 3
_DICTIONARY = 64 << 10
FEATURES = ("difference", "worst", "best", "ratio")


def build_dictionary(chunks: list[bytes]) -> bytes:
    """A trained dictionary, or, from too little text for training, the text itself."""
    try:
        return zstandard.train_dictionary(_DICTIONARY, chunks, level=_LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[:_DICTIONARY] or b"no text at all"


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        # without the frame's checks and sizes, so that small chunks differ by their content only
        params = zstandard.ZstdCompressionParameters.from_level(_LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.each = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(compression_params=params)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of FEATURES for each text."""
        out = np.zeros((len(offsets) - 1, len(FEATURES)))
        good, bad = (c.compress for c in self.each)
        view = memoryview(data)
        for t in range(len(out)):
            a, z = int(offsets[t]), int(offsets[t + 1])
            if a == z:
                out[t, 3] = 1.0
                continue
            cut = range(a, z, CHUNK) if z - a > CHUNK else (a,)
            g = np.array([len(good(view[s : min(s + CHUNK, z)])) for s in cut], float)
            b = np.array([len(bad(view[s : min(s + CHUNK, z)])) for s in cut], float)
            each = (g - b) / np.maximum(g, b)
            whole = (g.sum() - b.sum()) / max(g.sum(), b.sum())
            out[t] = whole, each.max(), each.min(), min(g.sum(), b.sum()) / (z - a)
        return out


class QualityModel:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.mean, self.spread = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
        self.weights = np.zeros(2 * len(FEATURES) + 1)

    def _terms(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return np.hstack([x, np.clip(x, -4, 4) ** 2])

    def calibrate(self, features: np.ndarray, label: np.ndarray) -> None:
        self.mean, self.spread = logistic.standardize(features)
        self.weights = logistic.fit(self._terms(features), label)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self._terms(features) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _run(model, score: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: QualityModel = model.value
        packed = Compressors(m.good, m.bad)
        for b in batches:
            for part in slices(b, b.num_columns - 1):
                f = packed.features(*text_bytes(part.column(part.num_columns - 1)))
                result = pa.array(m.score(f)) if score else pa.ListArray.from_arrays(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32), f.reshape(-1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], result], names=[f"c{i}" for i in range(part.num_columns)])

    return run


def _apply(rows: DataFrame, model: QualityModel, score: bool, name: str = "result") -> DataFrame:
    """All columns but the last, the text, and ``name``: the score, or the list of features."""
    kind = T.DoubleType() if score else T.ArrayType(T.DoubleType())
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, kind)])
    by_place = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return rows.mapInArrow(_run(rows.sparkSession.sparkContext.broadcast(model), score), by_place).toDF(*schema.names)


def train(docs: DataFrame, labels: DataFrame, *, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", per_label: int = 2500) -> QualityModel:
    """Dictionaries and calibration from labelled documents; see the module's text for the bounds."""
    marked = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    rows = labelled_texts(docs, labelled_sample(marked, "label", "id", 2 * per_label), id_column, text_column).where("text is not null")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(2)))
    spread = F.greatest(F.length("text") - CHUNK, F.lit(0)) + 1
    spots = F.array(*(F.substr("text", (F.pmod(F.xxhash64("id", F.lit(i)), spread) + 1).cast("int"), F.lit(CHUNK)) for i in range(CHUNKS_EACH)))
    some = F.slice(spots, 1, F.least(F.lit(CHUNKS_EACH), F.ceil(F.length("text") / CHUNK).cast("int") + 1))
    got = rows.where("part = 0 and text <> ''").select("id", "label", some.alias("chunks")).orderBy("id", "label").collect()
    chunks = [[c.encode() for r in got if r.label == k for c in r.chunks] for k in (1, 0)]
    model = QualityModel(build_dictionary(chunks[0]), build_dictionary(chunks[1]))
    fitted = _apply(rows.where("part = 1").select("id", "label", "text"), model, score=False).orderBy("id", "label").collect()
    model.calibrate(np.array([r.result for r in fitted]).reshape(-1, len(FEATURES)), np.array([r.label for r in fitted], float))
    model.weights[-1] += prior_shift(marked, "label", [r.label for r in fitted])
    return model


def score(docs: DataFrame, model: QualityModel, *, text_column: str = "text", keep: list[str | Column], score_column: str = "score") -> DataFrame:
    """The ``keep`` columns and the probability of label 1, for every row; ``score_column`` gets underscores at its end where it is kept already."""
    rows = with_text(docs, keep, text_column)
    return _apply(rows, model, score=True, name=unused(score_column, docs.select(*keep)))
