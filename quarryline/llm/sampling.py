"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import label_marks, may_hold
from .store import materialize

_UNIT = 1 << 30


def labelled_sample(rows: DataFrame, label: str, key: str, per_label: int, max_labels: int | None = 64) -> DataFrame:
    """About ``per_label`` rows of each of the ``max_labels`` most frequent labels (None: all), chosen by a hash of ``key``.

    Labels are counted over all rows first, so a label with a third of all rows gives no
    more rows than a rare one.  The choice depends on the rows alone: reruns agree.
    """
    counted = rows.where(F.col(label).isNotNull()).groupBy(label).count()
    if max_labels is None:
        rates = counted.select(label, F.least(F.lit(1.0), F.lit(per_label) / F.col("count")).alias("__rate"))
        chosen = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(_UNIT)) < F.col("__rate") * _UNIT
        return rows.join(F.broadcast(rates), label).where(chosen).select(*rows.columns)
    counts = counted.orderBy(F.desc("count"), label).limit(max_labels).collect()
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col(label) == F.lit(r[0]), min(1.0, per_label / r[1])).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(_UNIT)) < rate * _UNIT)


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, label, text) of the chosen (id, label) rows, written once; texts that are not chosen stay where they are."""
    some = docs.where(may_hold(id_column, chosen)).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return materialize(some.join(chosen, "id").select("id", "label", "text"), "labelled")


def all_labelled_texts(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, bits: int | None = None) -> DataFrame:
    """(id, label, text) of all (id, label) rows, whose labels are 0 and 1; only texts whose slot doesn't tell their label are shuffled to it, so there is no limit to the labels."""
    kind = docs.select(F.col(id_column).alias("id")).unionByName(labels.select("id")).schema["id"].dataType  # equal ids of two types have unlike slots
    texts, labels = docs.select(F.col(id_column).cast(kind).alias("id"), F.col(text_column).alias("text")).where("id is not null"), labels.withColumn("id", F.col("id").cast(kind))
    some = materialize(texts.withColumn("mark", label_marks("id", texts.select("id"), labels, bits)).where("mark > 0"), "marked")
    told = some.where("mark < 3").select("id", (F.col("mark") - 1).alias("label"), "text")
    return told.unionByName(materialize(some.where("mark = 3").join(labels, "id").select("id", "label", "text"), "labelled"))


def prior_shift(rows: DataFrame, label: str, sampled: list[int]) -> float:
    """What to add to the intercept of a model fitted on a sample, so that it fits the labels' shares in all rows."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}
    have = [sum(x == k for x in sampled) for k in (0, 1)]
    if not (counts.get(0) and counts.get(1) and have[0] and have[1]):
        return 0.0
    return math.log(counts[1] / counts[0]) - math.log(have[1] / have[0])
