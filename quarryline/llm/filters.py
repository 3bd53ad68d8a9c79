"""Dropping and labelling documents by id without moving the texts of those that stay."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The least and the most slots of a bitmap, as powers of two: 2 MB to 64 MB.
_BITS, _MOST_BITS = 24, 29
_TOP = 62


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or the first of ``name_``, ``name__`` ... that is no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame, keep: list[str | Column], text_column: str) -> DataFrame:
    """The ``keep`` columns, then the text under a name that none of them has."""
    kept = [F.col(f"`{c}`") if isinstance(c, str) else c for c in keep]
    return docs.select(*kept, F.col(f"`{text_column}`").alias(unused("text", docs.select(*kept))))


def slot(column: str) -> Column:
    """A hash of an id; a bitmap takes its low bits."""
    return F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(1 << _TOP))


def held(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    slots = slots & (8 * len(bitmap) - 1)
    return bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 == 1


def ids_bitmap(ids: DataFrame) -> Broadcast:
    """The set slots of all ids in ``ids`` (its first column): 8 bits or more for each id, within 2 to 64 MB; Spark builds it from all of them.

    Beyond some 60 million ids the bitmap fills, and lets ever more rows pass that the exact joins behind it then drop.
    """
    bits = min(max(_BITS, math.ceil(math.log2(8 * max(ids.count(), 1)))), _MOST_BITS)
    one = slot(ids.columns[0]) % (1 << bits) + 1  # Spark's bitmap functions number values from 1
    rows = ids.groupBy(F.bitmap_bucket_number(one).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("v")).collect()
    field = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        at = (r.k - 1) * 4096
        field[at : at + 4096] = np.frombuffer(bytes(r.v), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(field)


def may_hold(id_column: str, ids: DataFrame) -> Column:
    """True for every row whose id is in ``ids`` (its first column), and for few others."""
    bitmap = ids_bitmap(ids)

    @F.arrow_udf(T.BooleanType())
    def probe(slots: pa.Array) -> pa.Array:
        return pa.array(held(bitmap.value, slots.to_numpy()))

    return probe(slot(id_column))


def label_marks(id_column: str, ids: DataFrame, labels: DataFrame, bits: int | None = None) -> Column:
    """1 for ids of label 0, 2 for ids of label 1, 3 for ids that their slot doesn't tell, 0 for others; ``labels`` has (id, label), ``ids`` (id) of all rows that are asked, none of them null.

    A slot tells a label where only one id, labelled once, has it: so 1 and 2 are exact, and few unlabelled ids get 3.  Each label has a bitmap with
    8 bits or more for each id, of 2 to 32 MB; both are set where a slot doesn't tell.  Beyond some 30 million ids ever more of them get 3.
    """
    if bits is None:
        bits = min(max(_BITS, math.ceil(math.log2(8 * max(ids.count() + labels.count(), 1)))), _MOST_BITS - 1)
    one = slot("id") % (1 << bits) + 1
    every = ids.select("id", F.lit(None).cast("int").alias("label")).unionByName(labels.select("id", "label")).where("id is not null")
    placed = every.select("id", "label", F.bitmap_bucket_number(one).alias("k"), F.bitmap_bit_position(one).alias("at")).repartition("k")
    slots = placed.groupBy("k", "at").agg(F.count("label").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("label").alias("label")).where("n > 0")
    tells = (F.col("n") == 1) & (F.col("lo") == F.col("hi"))
    fields = np.zeros((2, (1 << bits) // 8), np.uint8)
    for r in slots.groupBy("k").agg(*(F.bitmap_construct_agg(F.when(~tells | (F.col("label") == x), F.col("at"))).alias(f"v{x}") for x in (0, 1))).collect():
        at = (r.k - 1) * 4096
        for x in (0, 1):
            fields[x, at : at + 4096] = np.frombuffer(bytes(r[f"v{x}"]), np.uint8)
    bitmaps = ids.sparkSession.sparkContext.broadcast(fields)

    @F.arrow_udf(T.IntegerType())
    def probe(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy()
        return pa.array(held(bitmaps.value[0], at) + 2 * held(bitmaps.value[1], at).astype(np.int32))

    return probe(slot(id_column))


def drop_ids(docs: DataFrame, ids: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (its first column); rows without an id stay."""
    suspect, name = may_hold(id_column, ids), unused("gone", docs)
    gone = ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    return docs.where(~suspect).unionByName(docs.where(suspect).join(gone, F.col(f"`{id_column}`") == F.col(name), "left_anti"))


def keep_one(docs: DataFrame, ids: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row, the first by text, of each id in ``ids`` (its first column); other rows stay as they are."""
    suspect, mark, no = may_hold(id_column, ids), unused("several", docs), unused("no", docs)
    several = ids.select(F.col(ids.columns[0]).alias(mark)).distinct()
    some = docs.where(suspect).join(several, F.col(f"`{id_column}`") == F.col(mark), "left")
    first = F.row_number().over(Window.partitionBy(id_column).orderBy(F.col(text_column)))
    once = some.where(F.col(mark).isNotNull()).withColumn(no, first).where(F.col(no) == 1)
    stay = some.where(F.col(mark).isNull()).unionByName(once.drop(no)).drop(mark)
    return docs.where(~suspect).unionByName(stay)
