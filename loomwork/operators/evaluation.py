"""Evaluation: forecast errors, fold means, confusion counts, A/B gates, field accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(df: DataFrame, keys: list[str], actual: str, predicted: str, digits: int = 4) -> DataFrame:
    """n, MAE, RMSE and MAPE (zero actuals left out; 0 where all are zero) of rows that have both values."""
    e = F.col(actual) - F.col(predicted)
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    mape = F.coalesce(F.avg(F.abs(F.try_divide(e, F.col(actual)))) * 100, F.lit(0.0))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), digits).alias("mae"), F.round(F.sqrt(F.avg(e * e)), digits).alias("rmse"), F.round(mape, digits).alias("mape"))


def fold_means(df: DataFrame, keys: list[str], actual: str, predicted: str, digits: int = 2) -> DataFrame:
    """Means over folds of each fold's rounded errors."""
    by_fold = errors(df, [*keys, "fold"], actual, predicted)
    return by_fold.groupBy(*keys).agg(F.count("*").alias("folds"), *(F.round(F.avg(m), digits).alias(m) for m in ("mae", "rmse", "mape")))


def confusion(truth: Column, guess: Column, suffix: str = "") -> list[Column]:
    """Counts of the four cases, then precision, recall and F1 (0 where undefined), as aggregate columns."""
    tp, fp, fn, tn = (F.count_if(x) for x in (truth & guess, ~truth & guess, truth & ~guess, ~truth & ~guess))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    named = {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4)}
    return [c.alias(n + suffix) for n, c in named.items()]


def gate(df: DataFrame, truth: str, base: str, candidate: str, least_precision: float = 0.9) -> DataFrame:
    """Both matchers' figures in one row and whether the candidate passes: F1 no worse and enough precision."""
    rows = df.agg(*confusion(F.col(truth), F.col(base), "_base"), *confusion(F.col(truth), F.col(candidate), "_candidate"))
    return rows.withColumn("passed", (F.col("f1_candidate") >= F.col("f1_base")) & (F.col("precision_candidate") >= least_precision))


def field_accuracy(df: DataFrame, case: str, field: str, expected: str, got: str, tolerance: float = 1e-6) -> DataFrame:
    """Coverage and accuracy over all, by field and by case in one pass of grouping sets."""
    match = F.coalesce(F.abs(F.col(expected) - F.col(got)) <= tolerance * F.greatest(F.abs(F.col(expected)), F.lit(1.0)), F.lit(False))
    rows = df.where(F.col(expected).isNotNull()).withColumn("__ok", match)
    out = rows.groupingSets([(), (field,), (case,)], field, case).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count(got).alias("n_found"), F.count_if("__ok").alias("n_correct"))
    return out.withColumns({"coverage": F.round(F.try_divide("n_found", "n"), 4), "accuracy": F.round(F.try_divide("n_correct", "n"), 4)})
