"""Fold and pooled regression metrics as grouped aggregates; undefined values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonlake.functions.sequence import safe_ratio
from codonlake.sources.store import held

NAMES = ("r2", "mae", "rmse", "pearson_r", "spearman_r")


#: Rows whose values one range of a group is meant to hold, and the most ranges of a group.
RANGE_ROWS = 1_000_000
MOST_RANGES = 4096


def _same(left: str, right: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}"))
    return on


def ranges_of(rows: DataFrame, keys: list[str], range_rows: int = RANGE_ROWS) -> int:
    """How many ranges the largest group asks for."""
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return min(MOST_RANGES, -(-largest // range_rows))


def value_ranks(rows: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    """(k0, k1, ..., value, rank): the average rank of each distinct value within its group.

    Values are counted first, so repeated ones are sorted once. A group is not sorted in one task: its distinct values
    are dealt into quantile ranges and accumulated inside (group, range); the counts of the ranges before give the offset.
    """
    own = [f"k{i}" for i in range(len(keys))]
    counted = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).alias("value")).agg(F.count("*").alias("n"))
    if ranges > 1:
        cuts = rows.groupBy(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)]).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts"))  # one row a group
        placed = counted.join(cuts, _same("k", "c", keys)).withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col("value")))).select(*own, "value", "n", "range")
    else:
        placed = counted.withColumn("range", F.lit(0))
    upto = F.sum("n").over(Window.partitionBy(*own, "range").orderBy("value"))
    inside = placed.withColumn("rank", upto - (F.col("n") - 1) / 2)
    if ranges <= 1:
        return inside.select(*own, "value", "rank")
    sizes = placed.groupBy(*own, "range").agg(F.sum("n").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy(*own).orderBy("range")) - F.col("held")
    before = sizes.select(*[F.col(o).alias(o.replace("k", "a")) for o in own], F.col("range").alias("at"), ahead.alias("ahead"))  # one row a group and range
    return inside.join(before, _same("k", "a", keys) & (F.col("range") == F.col("at"))).select(*own, "value", (F.col("rank") + F.col("ahead")).alias("rank"))


def ranked(rows: DataFrame, keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with average ranks ry and rp of y and y_hat within each group."""
    out, ranges = rows, ranges_of(rows, keys, range_rows)
    for value, name in (("y", "ry"), ("y_hat", "rp")):
        ranks = value_ranks(rows, keys, value, ranges)
        on = F.col(value).eqNullSafe(F.col("value"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"k{i}"))
        out = out.join(ranks, on).withColumn(name, F.col("rank")).drop("rank", "value", *[f"k{i}" for i in range(len(keys))])
    return out


def scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the five metrics of rows(y, y_hat) by group: values and their ranks in one aggregate."""
    n = F.count("*")
    err = F.col("y") - F.col("y_hat")
    moments = lambda x, y, a, b, c: [(F.var_pop(x) * n).alias(a), (F.var_pop(y) * n).alias(b), (F.covar_pop(x, y) * n).alias(c)]
    base = ranked(rows.select(*keys, "y", "y_hat"), keys).groupBy(*keys).agg(
        n.alias("n"), F.sum(err * err).alias("sse"), F.avg(F.abs(err)).alias("mae"), *moments("y", "y_hat", "yy", "pp", "yp"), *moments("ry", "rp", "ryy", "rpp", "ryp")
    )
    flat = F.col("yy") <= 0
    r2 = F.when(F.col("n") < 2, None).when(flat, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - safe_ratio(F.col("sse"), F.col("yy")))

    def correlation(x: str, y: str, both: str) -> Column:
        return F.when((F.col("n") >= 2) & (F.col(x) > 0) & (F.col(y) > 0), F.col(both) / F.nullif(F.sqrt(x) * F.sqrt(y), F.lit(0.0)))

    return base.select(*keys, r2.alias("r2"), "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), correlation("yy", "pp", "yp").alias("pearson_r"), correlation("ryy", "rpp", "ryp").alias("spearman_r"))


def fold_ordinal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with fold replaced by its place among the group's sorted distinct folds, from 0; a null fold raises."""
    checked = rows.withColumn("fold", F.when(F.col("fold").isNull(), F.raise_error(F.lit("every row needs a fold")).cast("int")).otherwise(F.col("fold")))
    folds = checked.select(*keys, "fold").distinct()
    order = Window.partitionBy(*keys).orderBy("fold")
    places = folds.withColumn("_place", (F.row_number().over(order) - 1))
    return checked.join(places, [*keys, "fold"]).drop("fold").withColumnRenamed("_place", "fold")


def summary(rows: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """Per-fold rows, their mean and population deviation, and the pooled row (computed from all predictions).

    strict: a fold without a value makes mean and deviation null; otherwise it is left out. Only r2 is listed if strict.
    Every prediction goes into its fold and into the pool in one pass, and is written once for all that follows; means and
    deviations are another grouping set of the scores.
    """
    names = NAMES[:1] if strict else NAMES
    fold = F.when(F.col("fold").isNull(), F.raise_error(F.lit("every row needs a fold")).cast("int")).otherwise(F.col("fold"))
    expanded = rows.select(*keys, fold.alias("fold"), "y", "y_hat").withColumn("pooled", F.explode(F.array(F.lit(False), F.lit(True))))
    expanded = held(expanded.withColumn("fold", F.when(~F.col("pooled"), F.col("fold"))))
    each = scores(expanded, [*keys, "pooled", "fold"])
    place = (F.row_number().over(Window.partitionBy(*keys, "pooled").orderBy("fold")) - 1).cast("string")
    each = each.withColumn("part", F.when(F.col("pooled"), "oof").otherwise(place)).select(*keys, "part", F.col("part").alias("own"), *names)
    folds = F.col("own") != "oof"

    def of(name: str, aggregate) -> Column:
        value = aggregate(F.when(folds, F.col(name)))
        return F.when(F.count_if(folds & F.col(name).isNull()) == 0, value) if strict else value

    sets = each.groupingSets([[*keys, "part"], keys], *keys, "part").agg(
        F.grouping("part").alias("all"), *[F.first(c).alias(f"one_{c}") for c in names], *[of(c, F.avg).alias(f"mean_{c}") for c in names], *[of(c, F.stddev_pop).alias(f"std_{c}") for c in names]
    )
    row = lambda label, kind: F.struct(label.alias("fold"), *[F.col(f"{kind}_{c}").alias(c) for c in names])
    out = F.when(F.col("all") == 1, F.array(row(F.lit("mean"), "mean"), row(F.lit("std"), "std"))).otherwise(F.array(row(F.col("part"), "one")))
    return sets.select(*keys, F.inline(out))
