"""Regression metrics over tables of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions.bins import tier
from gapline.operators.quantiles import quantiles
from gapline.operators.scale import HOT_ROWS, ONE_GROUP


def percentage_error(actual: str, predicted: str, min_actual: float = 0.01) -> Column:
    """Absolute percentage error, null where the actual value is too small to divide by."""
    a, p = F.col(actual), F.col(predicted)
    return F.when(a > min_actual, F.abs((a - p) / a) * 100)


def regression_metrics(df: DataFrame, actual: str, predicted: str, min_actual: float = 0.01,
                       by: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """mae, rmse, mape, accuracy (100 - mape), mdape and r2, per group if `by` is given."""
    key = by or ONE_GROUP
    rows = df if by else df.withColumn(ONE_GROUP, F.lit(0))
    rows = rows.select(key, F.col(actual).cast("double").alias("_a"),
                       F.col(predicted).cast("double").alias("_p"))
    rows = rows.withColumns({"_e": F.col("_a") - F.col("_p"),
                             "_ape": percentage_error("_a", "_p", min_actual)})
    sums = rows.groupBy(key).agg(
        F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg("_ape").alias("mape"), (100 - F.avg("_ape")).alias("accuracy"),
        (1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")),
                          F.var_pop("_a") * F.count("_a"))).alias("r2"))
    middle = quantiles(rows, "_ape", {"mdape": 0.5}, key, hot_rows)
    # One row per model on both sides.
    out = sums.join(middle, key)
    return out.select(*([by] if by else []), "mae", "rmse", "mape", "accuracy", "mdape", "r2")


def percentage_error_center(df: DataFrame, actual: str, predicted: str,
                            min_actual: float = 0.01, hot_rows: int = HOT_ROWS) -> DataFrame:
    m = regression_metrics(df, actual, predicted, min_actual, hot_rows=hot_rows)
    return m.select("mape", "mdape")


def long_predictions(wide: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """(model, actual, predicted): a prediction column per model turned into rows."""
    return wide.select(F.col(actual).alias("actual"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models])))


def compare(wide: DataFrame, actual: str, models: Sequence[str], min_actual: float = 0.01,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Metrics of every model, best accuracy first, with the accuracy tier."""
    long = long_predictions(wide, actual, models)
    rows = regression_metrics(long, "actual", "predicted", min_actual, "model", hot_rows)
    rounded = rows.select("model", *[F.round(c, 4).alias(c) for c in rows.columns if c != "model"])
    return rounded.withColumn("tier", tier(F.col("accuracy"))).orderBy(F.desc("accuracy"), "model")


def best_model(comparison: DataFrame) -> DataFrame:
    """One row: the model of the highest accuracy; equal ones go by name."""
    best = comparison.agg(F.max("accuracy").alias("_best"))
    top = comparison.join(F.broadcast(best), F.col("accuracy") == F.col("_best"))
    return top.agg(F.min("model").alias("model"), F.max("accuracy").alias("accuracy"))


def mean_ensemble(models: Sequence[str]) -> Column:
    return sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)


def weighted_ensemble(accuracy: dict[str, float], floor: float = 0.01) -> Column:
    """Prediction columns weighted by accuracy in percent, never below the floor."""
    weights = {m: max(floor, a / 100) for m, a in accuracy.items()}
    total = sum(weights.values())
    parts = [F.col(m) * F.lit(w) for m, w in weights.items()]
    return sum(parts[1:], parts[0]) / total


def accuracy_of(wide: DataFrame, actual: str, models: Sequence[str], min_actual: float = 0.01,
                ) -> dict[str, float]:
    """Accuracy in percent per prediction column: one row to the driver."""
    row = wide.agg(*[(100 - F.avg(percentage_error(actual, m, min_actual))).alias(m)
                     for m in models]).first()
    return {m: row[m] for m in models}
