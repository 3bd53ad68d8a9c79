"""Operator 13, embedding whitening by Chebyshev-filtered subspace iteration.

Entries are quantised to whole numbers, ``floor(scale * c) + offset``.  The fit list holds each distinct quantised vector once; its covariance V
(divisor n) is never formed.  Everything goes through passes over the fit list: each task centres its vectors, and adds up its part of ``Xt (X Q)`` for the
narrow matrix Q that is broadcast.

1. Q is a random orthonormal block of ``3 * components`` columns; a pass and a Rayleigh-Ritz step give the first estimates.
2. What is unwanted lies between a lower bound of all eigenvalues, from a few Lanczos passes, and the block's least Ritz value.  A Chebyshev
   polynomial of V, small there and growing fast beyond, is applied to Q by its three-term recurrence, one pass a degree.
3. QR, a pass, and Rayleigh-Ritz; again from 2 until the residual of every wanted pair is below ``tolerance`` times the largest eigenvalue.
4. Last, a pass measures the covariance of the whitened fit list against the identity.

Tasks return one matrix of (dimensions x block) each; those are added in groups by Spark before the driver adds the groups' sums.

Defined results: vectors that are null or hold a null or a non-finite entry take no part; null and repeated ids keep their rows.  Vectors of
different lengths are fitted apart, each length by itself; vectors without entries give no rows.  Components without variance (below ``1e-12`` of the largest) are not
returned, so a fit list of one vector, or an empty table, gives no rows.  Quantised entries are clipped to 2**61, and ``deviation`` to the range of a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize

_MOST = 1 << 61
_LEAST_SHARE = 1e-12
_PART = "part int, v binary"


@dataclass(frozen=True)
class Fit:
    """A fitted whitening of vectors of one length."""

    n: int
    sums: tuple[int, ...]
    #: Columns are components.
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def quantised(column: pa.Array, scale: int, offset: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are usable, and the whole-number vector of each of those."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = np.asarray(column.is_valid())
    some = column.filter(pa.array(valid))
    flat = np.asarray(some.flatten().cast(pa.float64()).fill_null(np.nan)) if len(some) else np.zeros(0)
    bounds = np.concatenate([[0], np.cumsum(np.asarray(some.value_lengths(), np.int64))]) if len(some) else np.zeros(1, np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = bad[bounds[1:]] == bad[bounds[:-1]]
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.floor(scale * flat), -_MOST, _MOST - offset - 1)
    x = np.where(np.isfinite(whole), whole, 0).astype(np.int64) + offset
    usable = valid.copy()
    usable[valid] = fine
    return usable, [x[a:b] for a, b, ok in zip(bounds[:-1], bounds[1:], fine, strict=True) if ok]


def packed(vectors: DataFrame, id_column: str, vector_column: str, scale: int, offset: int) -> DataFrame:
    """(id, d, x): the usable vectors; x is their entries as little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            usable, x = quantised(b.column(1), scale, offset)
            ids = b.column(0).filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(v) for v in x], pa.int32()), pa.array([v.astype("<i8").tobytes() for v in x], pa.binary())], names=["id", "d", "x"])

    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("d", T.IntegerType()), T.StructField("x", T.BinaryType())]))


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n; a whole number near the mean is taken off first, so that nothing is lost to the size of the entries."""
    near = [s // n for s in sums]
    rest = np.array([(s - n * a) / n for s, a in zip(sums, near, strict=True)])
    return (x - np.array(near, np.int64)).astype(np.float64) - rest


def deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The sum over dimensions of (n*x - S)**2 of each row, exact, and clipped to a long."""
    near = [s // n for s in sums]
    away = x - np.array(near, np.int64)
    most = int(np.abs(away).max(initial=0)) + 1
    if (n * most) ** 2 * x.shape[1] < 1 << 63:
        return ((n * away - np.array([s - n * a for s, a in zip(sums, near, strict=True)], np.int64)) ** 2).sum(axis=1)
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return np.array([min(v, (1 << 63) - 1) for v in exact], np.int64)


def _total(parts: DataFrame, tasks: int, most: int = 256) -> np.ndarray:
    """The sum of the arrays (part, v) of all tasks; beyond ``most`` tasks Spark adds them in groups, so that few reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(1).to_pylist():
                total = np.frombuffer(v) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    if tasks > most:
        parts = parts.repartition(math.isqrt(tasks), "part").mapInArrow(add, _PART)
    found = sorted(parts.toArrow().to_pylist(), key=lambda r: (r["part"], r["v"]))
    return sum((np.frombuffer(r["v"]) for r in found[1:]), np.frombuffer(found[0]["v"])) if found else np.zeros(0)


def _each_task(f: Callable[[np.ndarray], np.ndarray], d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One array a task: the sum of f over its batches of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                total = f(unpacked(b.column(0), d)) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], names=["part", "v"])

    return run


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...], int]:
    """The number of vectors, their sums by dimension, and the number of tasks that had some.  Sums are exact: in two halves of 31 bits, each a long while there are fewer than 2**31 vectors a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = unpacked(b.column(0), d)
            n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & (1 << 31) - 1).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([n, *high], pa.int64()), pa.array([0, *low], pa.int64())], names=["i", "high", "low"])

    whole = T.DecimalType(38, 0)
    rows = fit.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low"), F.count("*").alias("tasks")).collect()
    at = {r["i"]: (int(r["high"]) << 31) + int(r["low"]) if r["i"] >= 0 else int(r["high"]) for r in rows}
    return at.pop(-1, 0), tuple(at[i] for i in range(d)) if at else (), max((r["tasks"] for r in rows), default=0)


def _lower_bound(product: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> float:
    """A bound below V's eigenvalues by a few Lanczos steps: the least Ritz value less the norm of what is left; 0 is one anyway."""
    q = np.zeros((d, 0))
    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    diagonal, off = [], []
    for _ in range(min(steps, d)):
        q = np.column_stack([q, v])
        w = product(v[:, None])[:, 0]
        diagonal.append(float(v @ w))
        w -= q @ (q.T @ w)
        w -= q @ (q.T @ w)
        off.append(float(np.linalg.norm(w)))
        if off[-1] <= 1e-14 * max(diagonal):
            break
        v = w / off[-1]
    t = np.diag(diagonal) + np.diag(off[:-1], 1) + np.diag(off[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - off[-1])


def fit_length(fit: DataFrame, d: int, *, components: int = 16, degree: int = 10, lanczos_steps: int = 8, tolerance: float = 1e-13, most_rounds: int = 60, seed: int = 7) -> Fit | None:
    """Fit the whitening of the vectors (column x) of length ``d``, each taken once; None without any."""
    n, sums, tasks = _sums(fit, d)
    if not n:
        return None
    context = fit.sparkSession.sparkContext
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        """V q, by one pass."""
        nonlocal passes
        passes += 1
        shared = context.broadcast(q)

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ shared.value)

        out = _total(fit.mapInArrow(_each_task(part, d), _PART), tasks).reshape(q.shape) / n
        shared.unpersist()
        return out

    trace = float(_total(fit.mapInArrow(_each_task(lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), d), _PART), tasks)[0]) / n
    block = min(d, 3 * components)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, block)))[0]
    y = product(q)
    low = None
    best = math.inf
    for round_ in range(most_rounds):
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        order = np.argsort(-values)
        values, q, y = values[order], q @ turn[:, order], y @ turn[:, order]
        top = max(values[0], 0.0)
        wanted = [i for i in range(min(components, block)) if values[i] > _LEAST_SHARE * top]
        residual = max((float(np.linalg.norm(y[:, i] - values[i] * q[:, i])) for i in wanted), default=0.0)
        # certified; or as good as sums of doubles get, when a round no longer helps
        if residual <= tolerance * top or (residual <= 100 * tolerance * top and residual > best / 2):
            break
        best = min(best, residual)
        low = _lower_bound(product, d, lanczos_steps, rng) if low is None else low
        high = max(values[-1], low + _LEAST_SHARE * top)
        middle, half = (high + low) / 2, (high - low) / 2
        before, now = q, (y - middle * q) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (product(now) - middle * now) / half - before
            size = float(np.abs(now).max())  # keeps numbers small: the recurrence is linear
            before, now = before / size, now / size
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
        y = product(q)
    else:
        raise ArithmeticError(f"no certificate after {most_rounds} rounds: residual {residual:g} of {top:g}")
    vectors, values = q[:, wanted], values[wanted]
    shared = context.broadcast(vectors / np.sqrt(values))

    def whitened(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ shared.value
        return w.T @ w

    k = len(wanted)
    error = float(np.abs(_total(fit.mapInArrow(_each_task(whitened, d), _PART), tasks).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0
    return Fit(n, sums, vectors, values, trace, error, passes)


_OUT = (
    ("component", T.IntegerType(), pa.int32()),
    ("n", T.LongType(), pa.int64()),
    ("deviation", T.LongType(), pa.int64()),
    ("whitened", T.DoubleType(), pa.float64()),
    ("explained", T.DoubleType(), pa.float64()),
    ("identity_error", T.DoubleType(), pa.float64()),
)


def _projector(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = shared.value
        k, d = len(f.values), len(f.sums)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                x = unpacked(piece.column(1), d)
                w = centred(x, f.n, f.sums) @ (f.vectors / np.sqrt(f.values))
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, f.n)),
                        pa.array(np.repeat(deviation(x, f.n, f.sums), k)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(f.values / f.trace, rows)),
                        pa.array(np.full(rows * k, f.identity_error)),
                    ],
                    names=["id", *(name for name, _, _ in _OUT)],
                )

    return run


def whiten(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000, **options) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable vector and each of its components; see the module's text."""
    spark = vectors.sparkSession
    rows = materialize(packed(vectors, id_column, vector_column, scale, offset), "whiten-rows")
    distinct = materialize(rows.select("d", "x").distinct(), "whiten-fit")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(name, kind) for name, kind, _ in _OUT)])
    out = None
    for d in sorted(r["d"] for r in rows.where("d > 0").select("d").distinct().collect()):  # lengths, not vectors
        fitted = fit_length(distinct.where(F.col("d") == d).select("x"), d, components=components, **options)
        if fitted is None or not len(fitted.values):
            continue
        some = rows.where(F.col("d") == d).select("id", "x").mapInArrow(_projector(spark.sparkContext.broadcast(fitted)), schema)
        out = some if out is None else out.unionByName(some)
    out = spark.createDataFrame([], schema) if out is None else out
    names = [id_column, *(name if name != id_column else f"{name}_" for name, _, _ in _OUT)]
    return out.toDF(*names)
