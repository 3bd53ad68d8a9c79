"""A small logistic regression, for calibrating scores: on the driver for bounded samples, by sums over tasks for all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def fit(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps on the penalised likelihood; the intercept is free.

    Without both classes the weights are 0 and the intercept is that of the smoothed base rate.
    """
    n, d = x.shape
    both = bool(n) and y.min() != y.max()
    return _newton(n, d, float(y.sum()), both, lambda w: _sums(x, y, w), ridge, steps)


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the likelihood over some rows."""
    a = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T @ (p - y), (a * (p * (1 - p) + 1e-9)[:, None]).T @ a


def _newton(n: int, d: int, ones: float, both: bool, sums: Callable, ridge: float, steps: int) -> np.ndarray:
    w = np.zeros(d + 1)
    rate = (ones + 1) / (n + 2)
    w[-1] = np.log(rate / (1 - rate))
    if not both:
        return w
    penalty = np.full(d + 1, ridge * n / 100 + 1e-6)
    penalty[-1] = 1e-9
    for _ in range(steps):
        grad, hess = sums(w)
        move = np.linalg.solve(hess + np.diag(penalty), grad + penalty * w)
        w -= move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit_rows(rows: DataFrame, *, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, spreads, weights) of ``rows(y, x...)``, all doubles: the fit of the standardized columns to all rows.

    Each step is a pass over the rows, of which the driver gets one row of sums for each task.
    """
    d = len(rows.columns) - 1

    def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                if b.num_rows:
                    part = f(np.column_stack([x.to_numpy() for x in b.columns[1:]]), b.column(0).to_numpy())
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["sums"])

        got = [np.array(r.sums) for r in rows.mapInArrow(run, "sums array<double>").collect()]
        return sum(got) if got else None

    first = total(lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    if first is None:
        return np.zeros(d), np.ones(d), _newton(0, d, 0.0, False, None, ridge, steps)
    n, ones, mean = int(first[0]), float(first[1]), first[2:] / first[0]
    spread = np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n)
    spread = np.where(spread > 1e-12, spread, 1.0)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([v.ravel() for v in _sums((x - mean) / spread, y, w)])

        flat = total(part)
        return flat[: d + 1], flat[d + 1 :].reshape(d + 1, d + 1)

    return mean, spread, _newton(n, d, ones, 0 < ones < n, sums, ridge, steps)


def standardize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and spreads of the columns (1 where a column is constant)."""
    if not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1])
    spread = x.std(axis=0)
    return x.mean(axis=0), np.where(spread > 1e-12, spread, 1.0)
