"""Standardisation, and Lasso and ElasticNet from sufficient statistics.

One pass over the data gives each fold's counts, sums and cross products. The training data of a held-out fold are the
total minus that fold, and every ablation is a sub-matrix, so all ablations, folds and penalties share the one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of partial sums that one task adds up.
FAN_IN = 64


def scaled(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with the named columns centred and divided by their population deviation; a constant column is only centred."""
    moments = rows.agg(*[f(n).alias(f"{p}{n}") for n in names for p, f in (("_m_", F.avg), ("_s_", F.stddev_pop))])  # one row
    both = rows.crossJoin(F.broadcast(moments))
    rest = [F.col(c) for c in rows.columns if c not in names]
    return both.select(*rest, *[((F.col(n) - F.col(f"_m_{n}")) / F.when(F.col(f"_s_{n}") > 0, F.col(f"_s_{n}")).otherwise(1.0)).alias(n) for n in names])


@dataclass
class Moments:
    """Count and cross products of [1, x - shift..., y - shift]; the shift, common to all parts, keeps their digits."""

    cross: np.ndarray
    shift: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.cross - other.cross, self.shift)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.cross + other.cross, self.shift)

    @property
    def n(self) -> float:
        return self.cross[0, 0]

    def standardised(self, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """(gram, correlations with y, means, deviations, mean of y) of the chosen features, in standard units."""
        i = np.array(at) + 1
        mean = self.cross[0, i] / self.n
        y_mean = self.cross[0, -1] / self.n
        cov = self.cross[np.ix_(i, i)] / self.n - np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(cov), 0))
        deviation[deviation < 1e-12] = 1.0
        xy = (self.cross[i, -1] / self.n - mean * y_mean) / deviation
        return cov / np.outer(deviation, deviation), xy, mean + self.shift[np.array(at)], deviation, y_mean + self.shift[-1]


def _partial(shift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(b.num_rows), *(b.column(i + 1).to_numpy(zero_copy_only=False) - m for i, m in enumerate(shift))])
            for f in np.unique(fold):
                part = x[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(float).tobytes() for s in sums.values()], pa.binary())], names=["fold", "cross"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, float) for x in table.column("cross").to_pylist())
    return pa.table({"fold": table.column("fold")[:1], "cross": pa.array([total.tobytes()], pa.binary())})


def moments(rows: DataFrame, names: list[str], target: str = "te") -> dict[int, Moments]:
    """Cross products by fold, shifted by the means of all rows. The driver gets one matrix of (features + 2)^2 numbers a
    fold, whatever the number of rows.
    """
    columns = [*names, target]
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()  # one row
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    part = rows.select("fold", *columns).mapInArrow(_partial(shift), "fold int, cross binary")
    tree = part.withColumn("lot", F.spark_partition_id() % FAN_IN).groupBy("fold", "lot").applyInArrow(_added, "fold int, cross binary")
    out = tree.groupBy("fold").applyInArrow(_added, "fold int, cross binary").collect()
    width = len(names) + 2
    return {r["fold"]: Moments(np.frombuffer(r["cross"], float).reshape(width, width), shift) for r in out}


def accelerated(gram: np.ndarray, xy: np.ndarray, soft: float, ridge: float, most: int = 4000) -> np.ndarray:
    """A start near the minimum by accelerated proximal gradients with restarts: matrix products only."""
    w = z = np.zeros(len(xy))
    step = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]) + ridge, 1e-12)
    t = 1.0
    for i in range(most):
        moved = z - step * (gram @ z - xy + ridge * z)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * soft, 0.0)
        if (z - new) @ (new - w) > 0:
            t, z = 1.0, new
        else:
            grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z = new + (t - 1) / grown * (new - w)
            t = grown
        if i % 50 == 49 and np.abs(new - w).max() < 1e-7 * max(np.abs(new).max(), 1e-12):
            return new
        w = new
    return w


def coordinate_descent(gram: np.ndarray, xy: np.ndarray, alpha: float, l1_ratio: float, most: int = 10_000, tolerance: float = 1e-4) -> np.ndarray:
    """Minimises w'Gw / 2 - xy'w + alpha * l1_ratio * |w| + alpha * (1 - l1_ratio) / 2 * w'w.

    Ends when no coefficient moves by more than `tolerance` of the largest one over all features.
    """
    soft, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = accelerated(gram, xy, soft, ridge)
    slope = xy - gram @ w
    diagonal = np.diag(gram)
    active = np.arange(len(w))
    for sweep in range(most):
        change = 0.0
        for j in active:
            if diagonal[j] <= 0:
                continue
            z = slope[j] + diagonal[j] * w[j]
            new = np.sign(z) * max(abs(z) - soft, 0.0) / (diagonal[j] + ridge)
            if new != w[j]:
                slope -= gram[j] * (new - w[j])
                change = max(change, abs(new - w[j]))
                w[j] = new
        if change <= tolerance * max(np.abs(w).max(initial=0.0), 1e-12):
            if len(active) == len(w):
                break
            active = np.arange(len(w))
        elif sweep % 10 == 0:
            active = np.arange(len(w))
        else:
            active = np.flatnonzero(w)
    return w


PENALTIES = {"Lasso": (0.001, 1.0), "ElasticNet": (0.001, 0.5)}


@dataclass
class Linear:
    """A fitted linear model: coefficients in standard units, and what maps rows to them."""

    coefficients: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.means) / self.deviations) @ self.coefficients + self.intercept


def fit(m: Moments, at: list[int], model: str) -> Linear:
    gram, xy, means, deviations, y_mean = m.standardised(at)
    return Linear(coordinate_descent(gram, xy, *PENALTIES[model]), means, deviations, float(y_mean))


def predicted(rows: DataFrame, names: list[str], by_fold: dict[int, Linear], model: str) -> DataFrame:
    """(model, fold, id, y, y_hat) of rows(gene_id, fold, te, features): each fold by its own model, a product a batch."""
    schema = pa.schema([("model", pa.string()), ("fold", pa.int32()), ("id", pa.int64()), ("y", pa.float64()), ("y_hat", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            out = np.empty(b.num_rows)
            for f in np.unique(fold):
                out[fold == f] = by_fold[int(f)].predict(x[fold == f])
            yield pa.RecordBatch.from_arrays([pa.array([model] * b.num_rows, pa.string()), b.column(1), b.column(0), b.column(2), pa.array(out)], schema=schema)

    return rows.select("gene_id", "fold", "te", *names).mapInArrow(run, "model string, fold int, id long, y double, y_hat double")
