"""Operator 2, exact top-k search by tiled matrix products.

Vectors are quantised to whole numbers, ``floor(scale * x)``, and scored by the inner product.

* Queries, each distinct (id, vector) once, are dealt by hash into as many waves as keep what is broadcast
  near ``wave_bytes``; each wave reads the vectors once.  Results do not depend on the waves.
* A task multiplies tiles of ``tile_rows`` vectors with tiles of ``tile_rows``
  queries, and keeps for each query the best k of tile and list so far.
* Each task's lists are merged as a tree: groups of ``fan_in`` tasks to one list per query,
  then groups of groups, until one list for each query is left.  No merge ever holds more
  than ``fan_in * k`` entries of a query.

Products are exact: tiles whose sums stay below 2**53 go through float64 matrix
products, others through 64-bit integers, or Python's integers where those could overflow (such scores are
clipped to the range of a long).

Defined results: vectors that are null, hold a null or a non-finite component, or
have a null id take no part; so do vectors of another length than the query, for that query.  Candidates are all rows
whose id differs from the query's; a query id that repeats is one query for each distinct vector, which share
one list (the best of all of them); a repeated candidate row counts as often as it appears; equal scores go to the smaller id.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

_LIST_SCHEMA = "query_id long, part int, vec_id array<long>, score array<long>"
_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


def quantised(batch: pa.RecordBatch, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number rows (float64) of the usable vectors of a batch (id, embedding), by length."""
    ids, column = batch.column(0), batch.column(1)
    usable = np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
    column, ids = column.filter(pa.array(usable)), ids.filter(pa.array(usable)).to_numpy()
    if not len(column):
        return {}
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = values[bounds[at][:, None] + np.arange(n)]
        fine = np.isfinite(rows).all(axis=1)
        with np.errstate(over="ignore"):
            rows = np.floor(scale * rows[fine])
        out[int(n)] = (ids[at[fine]], np.clip(rows, -1.7e308, 1.7e308))
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if most < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    if most < 2.0**62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    exact = [[min(max(sum(int(a) * int(b) for a, b in zip(q, r, strict=True)), _MIN), _MAX) for r in rows] for q in queries]
    return np.array(exact, np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first by falling score, then rising id."""
    if len(scores) > 4 * k:  # cut to what reaches the k-th score before sorting; ties at the cut stay
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
        scores, ids = scores[keep], ids[keep]
    by = np.lexsort((ids, -scores.astype(np.float64) if scores.size and np.abs(scores).max() < 2**53 else ~scores))[:k]
    return scores[by], ids[by]


def _searcher(wave, k: int, tile_rows: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        for b in batches:
            for n, (ids, rows) in quantised(b, scale).items():
                if n not in wave.value:
                    continue
                q_ids, q = wave.value[n]
                lists = held.setdefault(n, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids))
                for s in range(0, len(rows), tile_rows):
                    tile, tile_ids = rows[s : s + tile_rows], ids[s : s + tile_rows]
                    for t in range(0, len(q), tile_rows):
                        scores = products(q[t : t + tile_rows], tile)
                        for i in range(len(scores)):
                            old, old_ids = lists[t + i]
                            row, row_ids = scores[i], tile_ids
                            own = row_ids == q_ids[t + i]
                            if own.any():
                                row, row_ids = row[~own], row_ids[~own]
                            if len(old) == k:  # most tiles have little that reaches the list
                                reach = row >= old[-1]
                                row, row_ids = row[reach], row_ids[reach]
                            if len(row):
                                lists[t + i] = best(np.concatenate([old, row]), np.concatenate([old_ids, row_ids]), k)
        for n, lists in held.items():
            q_ids = wave.value[n][0]
            full = [(int(i), x) for i, x in zip(q_ids, lists, strict=True) if len(x[0])]
            if full:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in full], pa.int64()),
                        pa.array([part] * len(full), pa.int32()),
                        pa.array([x[1] for _, x in full], pa.list_(pa.int64())),
                        pa.array([x[0] for _, x in full], pa.list_(pa.int64())),
                    ],
                    names=["query_id", "part", "vec_id", "score"],
                )

    return run


def _merge(lists: DataFrame, k: int, fan_in: int) -> DataFrame:
    """One level of the tree: the lists of ``fan_in`` neighbouring parts become one."""
    order = F.struct((-F.col("e.score")).alias("s"), F.col("e.vec_id").alias("v"), F.col("e.score").alias("score"))
    entries = lists.select("query_id", (F.col("part") / fan_in).cast("int").alias("part"), F.explode(F.arrays_zip("vec_id", "score")).alias("e"))
    merged = entries.groupBy("query_id", "part").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))
    return merged.select("query_id", "part", F.col("top.v").alias("vec_id"), F.col("top.score").alias("score"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    wave_bytes: int = 64 << 20,
    tile_rows: int = 1024,
    fan_in: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score), the k best of every query; see the module's text."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("embedding"))
    queries = vectors.where(is_query & F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("embedding"))
    queries = materialize(queries.distinct().withColumn("deal", F.pmod(F.xxhash64("id", "embedding", F.lit("wave")), F.lit(1 << 30))), "top-queries")
    size = queries.agg(F.sum(8 + 8 * F.size("embedding").cast("long"))).first()[0] or 0
    waves = -(-size * 5 // (4 * wave_bytes))  # a quarter more, for what a hash deals unevenly
    found = []
    for w in range(waves):
        wave = queries.where(F.col("deal") % waves == w).select("id", "embedding").orderBy("id", "embedding").toArrow().combine_chunks()
        usable: dict[int, tuple[list, list]] = {}
        for b in wave.to_batches():
            for n, (i, x) in quantised(b, scale).items():
                usable.setdefault(n, ([], []))[0].append(i)
                usable[n][1].append(x)
        if not usable:
            continue
        tiles = spark.sparkContext.broadcast({n: (np.concatenate(i), np.concatenate(x)) for n, (i, x) in usable.items()})
        found.append(materialize(rows.mapInArrow(_searcher(tiles, k, tile_rows, scale), _LIST_SCHEMA), "top-lists"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lists = found[0]
    for more in found[1:]:
        lists = lists.unionByName(more)
    parts = lists.agg(F.max("part")).first()[0]
    parts = 1 if parts is None else parts + 1
    while True:
        lists = _merge(lists, k, fan_in)
        parts = -(-parts // fan_in)
        if parts <= 1:
            break
    return lists.select("query_id", F.posexplode(F.arrays_zip("vec_id", "score")).alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score")
    )
