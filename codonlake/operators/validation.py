"""Cross-validation on folds that the rows bring along: out-of-fold predictions, refits and importances.

Lasso and ElasticNet come from sufficient statistics, LinearSVM and, beyond LOCAL_ROWS rows, SVR from passes over
distributed rows. Trees, and SVR on few rows or without a kernel of low rank, train on all rows of a split in one task each,
fanned out over (model, fold), each key a partition of its own. Those rows are sent by broadcast up to BROADCAST_BYTES and
beyond by a shuffle of packed batches, past the driver; a task must hold them all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.operators import learners, linear, support
from codonlake.operators.ranking import model_place

BROADCAST_BYTES = 8 << 20
#: Rows up to which SVR is solved pair by pair in a task; its time grows with their square.
LOCAL_ROWS = 2000
MODELS = ("Lasso", "ElasticNet", "RandomForest", "LightGBM", "XGBoost", "SVR", "LinearSVM")


def split_sizes(rows: DataFrame) -> DataFrame:
    """(fold, n_test, n_train) of each held-out fold."""
    sizes = rows.groupBy("fold").agg(F.count("*").alias("n_test"))  # one row a fold
    total = sizes.agg(F.sum("n_test").alias("_all"))
    return sizes.crossJoin(F.broadcast(total)).select("fold", "n_test", (F.col("_all") - F.col("n_test")).alias("n_train"))


def _checked(rows: DataFrame, names: list[str]) -> DataFrame:
    missing = rows.filter("fold IS NULL OR te IS NULL").limit(1).count()
    if missing:
        raise ValueError("every row needs a fold and a target")
    if not names:
        raise ValueError("no feature columns")
    return rows


@dataclass
class Sums:
    """Cross products by fold of some columns: one pass over the data serves every selection of them."""

    names: list[str]
    by_fold: dict[int, linear.Moments]

    @classmethod
    def of(cls, rows: DataFrame, names: list[str]) -> Sums:
        return cls(names, linear.moments(rows, names))

    def fit(self, names: list[str], model: str) -> tuple[dict[int, linear.Linear], linear.Linear]:
        """The model of each held-out fold, trained on the others, and the one of all rows."""
        at = [self.names.index(n) for n in names]
        total = reduce(lambda a, b: a + b, self.by_fold.values())
        alone = len(self.by_fold) == 1
        return {f: linear.fit(total if alone else total - part, at, model) for f, part in self.by_fold.items()}, linear.fit(total, at, model)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one value."""
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def _fanned(rows: DataFrame, names: list[str], keys: list[tuple], work, schema: str) -> DataFrame:
    """`work(key, rows)` for each key in a task of its own, with all rows in order of gene_id; they travel by broadcast, or
    packed by a shuffle beyond the bound."""
    spark = rows.sparkSession
    places = spark.range(0, len(keys), 1, len(keys))
    if rows.count() * (len(names) + 3) * 8 <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(rows.orderBy("gene_id").toPandas())

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in b["id"]:
                    yield work(keys[i], shared.value)

        return places.mapInPandas(one, schema)

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = defaultdict(list)
        for b in batches:
            for i, part in zip(b["id"], b["rows"], strict=True):
                held[i].append(pa.ipc.open_stream(part).read_all())
        b = part = None  # nothing but the sorted rows stays
        for i in list(held):
            own = pa.concat_tables(held.pop(i))
            own = own.take(np.argsort(own.column("gene_id").to_numpy(), kind="stable"))
            yield work(keys[i], own.to_pandas(split_blocks=True, self_destruct=True))

    sent = rows.mapInArrow(_packed, "rows binary").crossJoin(F.broadcast(places))  # a few keys
    return sent.repartitionById(len(keys), F.col("id").cast("int")).mapInPandas(gathered, schema)


@contextmanager
def _kept(rows: DataFrame) -> Iterator[DataFrame]:
    """rows for many passes: in as many partitions as tasks run at a time, kept by the executors while it lasts."""
    kept = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _supported(rows: DataFrame, names: list[str], models: list[str], folds: list[int | None]) -> dict[str, dict[int | None, support.Fitted]]:
    """LinearSVM and SVR without each of the folds (None: of all rows); SVR only if it is to be solved over distributed rows."""
    out: dict[str, dict[int | None, support.Fitted]] = {}
    if not {"LinearSVM", "SVR"} & set(models):
        return out
    with _kept(rows) as kept:
        for m in ("LinearSVM", "SVR"):
            if m in models and (m == "LinearSVM" or kept.count() > LOCAL_ROWS):
                spaces = support.spaces_of(kept, names, folds, m == "SVR")
                if spaces is not None:
                    out[m] = {f: support.Fitted(s, w) for f, s, w in zip(folds, spaces, support.solved(kept, names, spaces, m), strict=True)}
    return out


def out_of_fold(rows: DataFrame, names: list[str], models: list[str], scale: float = 1.0, sums: Sums | None = None) -> DataFrame:
    """(model, fold, id, y, y_hat): each row predicted by a model that was trained on the other folds.

    sums: cross products of the same rows, of these columns or more, where they are there already.
    """
    rows = _checked(rows.select("gene_id", "fold", "te", *names), names)
    unknown = [m for m in models if m not in MODELS]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    straight = [m for m in models if m in linear.PENALTIES]
    sums = sums or (Sums.of(rows, names) if straight else None)
    parts = [linear.predicted(rows, names, sums.fit(names, m)[0], m) for m in straight]
    heavy = [m for m in models if m not in linear.PENALTIES]
    if heavy:
        folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
        solved = _supported(rows, names, heavy, folds)
        parts += [linear.predicted(rows, names, by_fold, m) for m, by_fold in solved.items()]
        heavy = [m for m in heavy if m not in solved]

    if heavy:

        def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
            model, fold = key
            test = (data["fold"] == fold).to_numpy()
            train = ~test if (~test).any() else test
            x, y = data[names].to_numpy(float), data["te"].to_numpy(float)
            made = learners.make(model, scale)
            y_hat = made.foretold(x[train], y[train], x[test]) if isinstance(made, learners.Forest) else made.fit(x[train], y[train]).predict(x[test])
            return pd.DataFrame({"model": model, "fold": np.int32(fold), "id": data["gene_id"].to_numpy()[test], "y": y[test], "y_hat": y_hat})

        parts.append(_fanned(rows, names, [(m, f) for m in heavy for f in folds], run, "model string, fold int, id long, y double, y_hat double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(rows: DataFrame, names: list[str], models: list[str], scale: float = 1.0, repeats: int = 5, sums: Sums | None = None) -> DataFrame:
    """(model, feature_idx, feature, importance, signed_coef) of models fitted on all rows, in MODEL_ORDER and then by feature."""
    spark = rows.sparkSession
    rows = _checked(rows.select("gene_id", "fold", "te", *names), names)
    table = []
    if straight := [m for m in models if m in linear.PENALTIES]:
        sums = sums or Sums.of(rows, names)
        for m in straight:
            coefficients = sums.fit(names, m)[1].coefficients
            table += [(m, i, n, abs(float(w)), float(w)) for i, (n, w) in enumerate(zip(names, coefficients, strict=True))]
    schema = "model string, feature_idx int, feature string, importance double, signed_coef double"
    out = spark.createDataFrame(table, schema)
    heavy = [m for m in models if m not in linear.PENALTIES]
    for m, by_fold in _supported(rows, names, heavy, [None]).items():
        heavy.remove(m)
        fitted = by_fold[None]
        signed = fitted.coefficients
        value = np.abs(signed) if signed is not None else support.permutation_importance(fitted, rows, names, repeats)
        out = out.unionByName(spark.createDataFrame([(m, i, n, float(value[i]), None if signed is None else float(signed[i])) for i, n in enumerate(names)], schema))
    if heavy:

        def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
            x, y = data[names].to_numpy(float), data["te"].to_numpy(float)
            fitted = learners.make(key[0], scale)
            fitted.foretold(x, y, x[:0]) if isinstance(fitted, learners.Forest) else fitted.fit(x, y)
            signed = getattr(fitted, "coefficients", None)
            value = np.abs(signed) if signed is not None else getattr(fitted, "importance", None)
            if value is None:
                value = learners.permutation_importance(fitted, x, y, repeats)
            return pd.DataFrame({"model": key[0], "feature_idx": np.arange(len(names), dtype=np.int32), "feature": names, "importance": value, "signed_coef": signed if signed is not None else [None] * len(names)})

        out = out.unionByName(_fanned(rows, names, [(m,) for m in heavy], run, schema))
    return out.filter(F.col("model").isin(*models)).orderBy(model_place(), "feature_idx")


def violations(rows: DataFrame, names: list[str], model: str) -> DataFrame:
    """(model, fold, feature, violation): how far each held-out fold's Lasso or ElasticNet is from its optimality
    conditions. The residuals' correlations with the standardised features come from the rows, not from the cross
    products that the models were solved from: one more pass, with partial sums by fold.
    """
    fitted = Sums.of(rows, names).fit(names, model)[0]
    alpha, share = linear.PENALTIES[model]
    folds = sorted(fitted)

    means, deviations, weights = (np.array([getattr(fitted[f], k) for f in folds]) for k in ("means", "deviations", "coefficients"))
    shift = means.mean(0)
    slopes, ahead = (weights / deviations).T, np.array([fitted[f].intercept for f in folds]) - ((means - shift) * weights / deviations).sum(1)

    def partial(batches):
        """Of a batch, two matrix products serve all folds; rows are standardised in the sums."""
        sums, left_over, n = np.zeros((len(names), len(folds))), np.zeros(len(folds)), np.zeros(len(folds))
        for b in batches:
            own, y, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            x = np.column_stack(columns) - shift
            trained = own[:, None] != np.array(folds) if len(folds) > 1 else np.ones((len(own), 1), bool)
            left = np.where(trained, y[:, None] - ahead - x @ slopes, 0.0)
            sums += x.T @ left
            left_over += left.sum(0)
            n += trained.sum(0)
        slope = (sums.T - (means - shift) * left_over[:, None]) / deviations
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(folds, np.int32), len(names))), pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(folds))), pa.array(slope.ravel()), pa.array(np.repeat(n, len(names)))], names=["fold", "idx", "slope", "n"])

    total = rows.select("fold", "te", *names).mapInArrow(partial, "fold int, idx int, slope double, n double").groupBy("fold", "idx").agg((F.sum("slope") / F.sum("n")).alias("slope"))
    w = rows.sparkSession.createDataFrame([(f, i, n, float(c)) for f in folds for i, (n, c) in enumerate(zip(names, fitted[f].coefficients, strict=True))], "fold int, idx int, feature string, w double")
    pull = F.col("slope") - alpha * (1 - share) * F.col("w")
    gap = F.when(F.col("w") == 0, F.greatest(F.abs(pull) - alpha * share, F.lit(0.0))).otherwise(F.abs(pull - alpha * share * F.signum("w")))
    return total.join(F.broadcast(w), ["fold", "idx"]).select(F.lit(model).alias("model"), "fold", "feature", gap.alias("violation"))
