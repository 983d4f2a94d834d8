"""Rankings of feature importances, and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_CSV, TOP_BAR, TOP_HEATMAP = 50, 30, 25
MODEL_ORDER = ("Lasso", "ElasticNet", "LinearSVM", "RandomForest", "LightGBM", "XGBoost", "SVR")


def model_place(model: str = "model") -> Column:
    """Place of a model in MODEL_ORDER; others come last."""
    place = F.create_map(*[F.lit(x) for i, m in enumerate(MODEL_ORDER) for x in (m, i)])
    return F.coalesce(F.try_element_at(place, F.col(model)), F.lit(len(MODEL_ORDER)))


def top_features(rows: DataFrame, most: int = TOP_CSV) -> DataFrame:
    """model, rank, feature, importance, signed_coef of each model's first features; ties in feature order."""
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature_idx")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("model", "rank", "feature", "importance", "signed_coef")


def bars(rows: DataFrame, most: int = TOP_BAR) -> DataFrame:
    """Top features with the side of their bar; a coefficient of 0 counts as negative, no coefficient as none."""
    sign = F.when(F.col("signed_coef").isNull(), None).when(F.col("signed_coef") > 0, "positive").otherwise("negative")
    return top_features(rows, most).withColumn("sign", sign)


def heatmap(rows: DataFrame, most: int = TOP_HEATMAP) -> DataFrame:
    """(feature, model, value) over the union of all models' top features; a model's largest value is 1, null if all are 0."""
    chosen = top_features(rows, most).select("feature").distinct()
    models = rows.select("model").distinct()
    grid = chosen.crossJoin(F.broadcast(models))  # a few names by a few models
    filled = grid.join(top_features(rows, most).select("model", "feature", "importance"), ["model", "feature"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    top = F.max("importance").over(Window.partitionBy("model"))
    return filled.select("feature", "model", (F.col("importance") / F.nullif(top, F.lit(0.0))).alias("value"))


def heatmap_wide(rows: DataFrame, models: list[str], most: int = TOP_HEATMAP) -> DataFrame:
    """One row a feature, sorted by name, one column a model."""
    return heatmap(rows, most).groupBy("feature").pivot("model", models).agg(F.first("value")).orderBy("feature")
