"""Forecasters, anomaly scores and the product categorizer.

Trees are those of :mod:`boosting`, logistic regression is Spark ML's. Models of one short series each (ARIMA, windows, isolation forests) run in one
group per series, so that many series spread over the cluster; a series of monthly values is small.
"""

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arima as A
from . import boosting as B
from . import text as X

#: Tree booster, anomaly detector, window model and categorizer settings.
TREES, SEED = B.Profile(trees=100, depth=4, rate=0.1), 42
CONTAMINATION, LEAST_POINTS, FOREST, SAMPLE = 0.05, 12, 100, 256
SEQUENCE, HORIZON = 12, 6
CONFIDENCE, MARGIN, LEAST_NAME, UNKNOWN = 0.22, 0.04, 3, "unknown"
#: Rows that the categorizer is fitted on, and codes that it may know, at most.
TRAIN_ROWS, MOST_CODES = 2000, 5000


# --- boosted trees -------------------------------------------------------------------------------------------------


def numeric_features(df: DataFrame, target: str, exclude: tuple[str, ...] = ("period",)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (target, *exclude)]


def train_trees(df: DataFrame, target: str, features: list[str], profile: B.Profile = TREES, **changes) -> B.Booster:
    """A booster on the rows with a target; features keep their nulls (see :mod:`boosting`). ``changes`` replace settings of the profile."""
    return B.fit(df, target, features, replace(profile, **changes))


def importances(model: B.Booster, features: list[str]) -> list[tuple[str, float]]:
    """Mean gain of each feature's splits, largest first; 0 for a feature that no split uses."""
    gains = {f: g for f, g, _ in B.importances(model)}
    return sorted(((f, gains.get(f, 0.0)) for f in features), key=lambda x: (-x[1], x[0]))


def holdout(df: DataFrame, target: str, features: list[str], train_end: str, period: str = "period", least: int = 24, **changes) -> tuple[str, DataFrame | None]:
    """(status, predictions of the months after ``train_end`` by a model of those up to it)."""
    train = df.where(F.date_format(period, "yyyy-MM") <= train_end)
    if train.count() < least:
        return "insufficient_data", None
    model = train_trees(train, target, features, **changes)
    test = df.where(F.date_format(period, "yyyy-MM") > train_end)
    return "ok", B.predicted(test, model).select(*df.columns, F.round("prediction", 4).alias("predicted"))


def recursive_features(history: list[float | None]) -> dict[str, float | None]:
    """The next step's value-derived features from the last values: lags, trailing means and growth."""
    last = lambda k: history[-k] if len(history) >= k else None
    mean = lambda n: (lambda v: sum(v) / len(v) if v else None)([x for x in history[-n:] if x is not None])
    a, b = last(1), last(2)
    return {"value_lag1": a, "value_lag2": b, "value_lag3": last(3), "value_roll3m": mean(3), "value_roll6m": mean(6), "growth": a / b - 1 if a is not None and b else None}


def forecast_trees(spark, model: B.Booster, features: list[str], history: list[float], held: dict[str, float | None], steps: int) -> list[float]:
    """One step after another: value-derived features are renewed from what was forecast, others held. At most 24 steps."""
    if not 1 <= steps <= 24:
        raise ValueError("1 to 24 steps")
    history, out = list(history), []
    for _ in range(steps):
        history.append(B.predict_one(model, held | recursive_features(history)))
        out.append(round(history[-1], 2))
    return out


# --- series models -------------------------------------------------------------------------------------------------


def month_numbers(periods: pd.Series) -> np.ndarray:
    at = pd.to_datetime(periods)
    return (at.dt.year * 12 + at.dt.month).to_numpy()


def arima(df: DataFrame, key: str, value: str = "value", period: str = "period", steps: int = 6, least: int = 24) -> DataFrame:
    """(key, status, order, step, predicted) for every monthly series by exact likelihood; null and absent months are missing ones.

    A series with fewer than ``least`` values has the status insufficient_data, one with a month twice repeated_months.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period)
        name, y, months = pdf[key].iloc[0], pdf[value].astype(float).to_numpy(), month_numbers(pdf[period])
        status = "insufficient_data" if (~np.isnan(y)).sum() < least else "repeated_months" if (np.diff(months) <= 0).any() else "ok"
        if status != "ok":
            return pd.DataFrame({key: [name], "status": [status], "order": [None], "step": [None], "predicted": [None]}).astype({"step": "Int64"})
        (y,) = A.monthly_grid(months, y)
        model = A.fit(y)
        return pd.DataFrame({key: name, "status": "ok", "order": model.order, "step": range(1, steps + 1), "predicted": np.round(A.ahead(y, None, model, steps), 2)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, period, value).groupBy(key).applyInPandas(run, f"{key} {kind}, status string, order string, step long, predicted double")


def window_forecast(df: DataFrame, key: str, value: str = "value", period: str = "period", length: int = SEQUENCE, horizon: int = HORIZON, ridge: float = 1.0, test_rows: int = HORIZON) -> DataFrame:
    """(key, status, step, predicted, mape): all steps at once from the last window, by ridge regression on scaled windows.

    Scale and weights come from the rows before the last ``test_rows``, whose errors are reported.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period)
        y, name = pdf[value].astype(float).to_numpy(), pdf[key].iloc[0]
        train = y[: len(y) - test_rows]
        if len(train) < length + horizon + 4 or np.isnan(y).any():
            return pd.DataFrame({key: [name], "status": ["insufficient_data"], "step": pd.array([None], "Int64"), "predicted": [None], "mape": [None]})
        mean, std = train.mean(), train.std() or 1.0
        z = (train - mean) / std
        x = np.lib.stride_tricks.sliding_window_view(z, length)[: len(z) - length - horizon + 1]
        t = np.lib.stride_tricks.sliding_window_view(z[length:], horizon)
        x1 = np.c_[x, np.ones(len(x))]
        w = np.linalg.solve(x1.T @ x1 + ridge * np.eye(length + 1), x1.T @ t)
        ahead = lambda s: (np.r_[(s[-length:] - mean) / std, 1.0] @ w) * std + mean
        test = y[len(train) : len(train) + horizon]
        use = test != 0
        mape = float(np.mean(np.abs((ahead(train)[: len(test)][use] - test[use]) / test[use])) * 100) if use.any() else 0.0
        return pd.DataFrame({key: name, "status": "ok", "step": range(1, horizon + 1), "predicted": np.round(ahead(y), 2), "mape": round(mape, 4)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, period, value).groupBy(key).applyInPandas(run, f"{key} {kind}, status string, step long, predicted double, mape double")


def path_lengths(x: np.ndarray, trees: int, rng: np.random.RandomState) -> np.ndarray:
    """Mean depth at which random cuts single each row out, over its expectation: the isolation score's exponent."""
    n = min(SAMPLE, len(x))
    expected = lambda m: 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1) if np.ndim(m) == 0 and m > 2 else float(m == 2)
    limit, total = int(np.ceil(np.log2(max(n, 2)))), np.zeros(len(x))
    for _ in range(trees):
        todo = [(np.arange(len(x)), rng.choice(len(x), n, replace=False), 0)]
        while todo:
            rows, sample, depth = todo.pop()
            lo, hi = (x[sample].min(0), x[sample].max(0)) if len(sample) else (None, None)
            if not len(rows):
                continue
            if depth >= limit or len(sample) <= 1 or not (hi > lo).any():
                total[rows] += depth + expected(len(sample))
                continue
            c = rng.choice(np.flatnonzero(hi > lo))
            cut = rng.uniform(lo[c], hi[c])
            left, in_left = x[rows, c] < cut, x[sample, c] < cut
            todo += [(rows[left], sample[in_left], depth + 1), (rows[~left], sample[~in_left], depth + 1)]
    return total / trees / max(expected(n), 1e-9)


def anomalies(df: DataFrame, key: str, value: str = "value", period: str = "period", contamination: float = CONTAMINATION, seed: int = SEED, least: int = LEAST_POINTS) -> DataFrame:
    """(key, period, value, score, is_anomaly) of rows whose features are all there; negative scores are anomalies.

    Features: the value, three lags, the last three rows' mean and deviation, and the change. Series with fewer than
    ``least`` such rows are left out. A contamination outside (0, 0.5) becomes the default.
    """
    share = contamination if 0 < contamination < 0.5 else CONTAMINATION

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period).reset_index(drop=True)
        v = pdf[value].astype(float)
        x = pd.DataFrame({"v": v, **{f"lag{k}": v.shift(k) for k in (1, 2, 3)}, "mean": v.rolling(3).mean(), "std": v.rolling(3).std(), "change": v / v.shift(1) - 1})
        x = x.replace([np.inf, -np.inf], np.nan).dropna()
        if len(x) < least:
            return pd.DataFrame({key: pd.Series(dtype=object), period: pd.Series(dtype=object), value: pd.Series(dtype=float), "score": pd.Series(dtype=float), "is_anomaly": pd.Series(dtype=bool)})
        depth = path_lengths(x.to_numpy(), FOREST, np.random.RandomState(seed))
        raw = -np.exp2(-depth)
        score = raw - np.quantile(raw, share)
        rows = pdf.loc[x.index]
        return pd.DataFrame({key: rows[key], period: rows[period], value: rows[value].astype(float), "score": np.round(score, 6), "is_anomaly": score < 0})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, period, value).groupBy(key).applyInPandas(run, f"{key} {kind}, {period} date, {value} double, score double, is_anomaly boolean")


# --- product categorizer -------------------------------------------------------------------------------------------


def train_categorizer(labelled: DataFrame, name: str, code: str, strength: float = 4.0, features: int = 1 << 14, key: str | None = None, sample_rows: int = TRAIN_ROWS) -> PipelineModel:
    """Character n-grams of names, weighed by rarity, and a multinomial regression; unlabelled rows are the class ``unknown``.

    It is fitted on ``sample_rows`` rows at most: those with the smallest hash of ``key`` (of the name without a key).
    """
    order = F.xxhash64(F.col(key or name))
    rows = labelled.select(order.alias("order"), X.ngrams(F.col(name)).alias("terms"), F.coalesce(F.col(code), F.lit(UNKNOWN)).alias("code")).orderBy("order", "code").limit(sample_rows).drop("order")
    n = max(rows.count(), 1)
    stages = [StringIndexer(inputCol="code", outputCol="label", stringOrderType="alphabetAsc"), HashingTF(inputCol="terms", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features"), LogisticRegression(family="multinomial", regParam=1 / (strength * n), maxIter=60)]
    return Pipeline(stages=stages).fit(rows)


def known_codes(df: DataFrame, code: str, most: int = MOST_CODES) -> list[str]:
    """All codes of a column; more than ``most`` are refused, none is left out."""
    found = [r[0] for r in df.where(F.col(code).isNotNull()).select(code).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} codes")
    return sorted(found)


def categorize(model: PipelineModel, products: DataFrame, name: str, allowed: list[str]) -> DataFrame:
    """``products`` with ``code`` (null when abstaining), ``confidence``, ``margin`` and ``reason``."""
    labels = model.stages[0].labels
    scored = products.withColumn("terms", X.ngrams(F.col(name)))
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    ranked = F.sort_array(F.zip_with(vector_to_array("probability"), F.array(*map(F.lit, labels)), lambda p, c: F.struct(p.alias("p"), c.alias("c"))), asc=False)
    scored = scored.withColumn("__r", ranked).withColumn("__top", F.col("__r")[0]).withColumn("confidence", F.round("__top.p", 6))
    margin = F.round(F.col("__top.p") - F.coalesce(F.try_element_at("__r", F.lit(2)).p, F.lit(0.0)), 6)
    scored = scored.withColumn("margin", margin)
    top = F.col("__top.c")
    reason = (
        F.when(F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) < LEAST_NAME, "too_short").when(top == UNKNOWN, "unknown_class").when(~top.isin(*allowed), "not_allowed")
        .when(F.col("confidence") < CONFIDENCE, "low_confidence").when(F.col("margin") < MARGIN, "low_margin")
    )
    scored = scored.withColumns({"reason": reason, "code": F.when(reason.isNull(), top)})
    return scored.select(*products.columns, "code", "confidence", "margin", "reason")
