"""Training and forecasting over all models: holdouts, exogenous columns, isolated failures, dispatch, artifacts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arima as A
from . import boosting as B
from . import models as M

#: The holdout's months, the fewest months to train on, rows tested where the months are not there, and exogenous columns.
TRAIN_END, TEST_START, LEAST_TRAIN, TEST_ROWS = "2023-12", "2024-01", 24, 6
EXOGENOUS = ("indigo", "indigo_lag1", "mei_ip")
#: Models by name with the most months ahead that they forecast (None: no limit).
MOST_AHEAD = {"arima": None, "xgboost": None, "lightgbm": None, "lstm": 6}
#: Profiles of tree boosters; the second grows by leaves, of twenty rows at least, without a penalty of their values.
BOOSTERS = {"xgboost": M.TREES, "lightgbm": B.Profile(trees=100, depth=4, rate=0.1, leaves=31, least_rows=20, squares=0.0)}


def reindexed(target: DataFrame, features: DataFrame, on: str = "period") -> DataFrame:
    """``features`` on exactly the rows of ``target``'s ``on``; null where features have no such row."""
    return target.select(on).distinct().join(features, on, "left")


# --- ARIMA with exogenous columns ----------------------------------------------------------------------------------


def split_rows(months: Sequence[str], train_end: str, test_start: str, least: int, test_rows: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of training and test rows: by the fixed months where both sides are there, else the last ``test_rows``."""
    m = np.array(months)
    train, test = np.flatnonzero(m <= train_end), np.flatnonzero(m >= test_start)
    if test_start > train_end and len(train) >= least and len(test):
        return train, test
    n = len(m) - test_rows
    return (np.arange(n), np.arange(n, len(m))) if n >= least else None


ARTIFACT = "status string, kind string, order string, drift double, phi double, theta double, beta array<double>, variance double, loglik double, history array<double>, rows array<array<double>>, last_period date, n_train int, n_test int, mae double, rmse double, mape double"


def train_arima(df: DataFrame, key: str, exogenous: Sequence[str] = (), value: str = "value", period: str = "period", train_end: str = TRAIN_END, test_start: str = TEST_START, least: int = LEAST_TRAIN, test_rows: int = TEST_ROWS) -> DataFrame:
    """A row for each series: status, errors of the holdout, and a model fitted on the whole series (the artifact).

    Null and absent months, and those that lack any of the exogenous columns, are missing ones; where a series has no such column at all, it
    is fitted without. Statuses: ok, insufficient_data, repeated_months.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period)
        out = {key: pdf[key].iloc[0], "status": "ok"}
        columns = [c for c in exogenous if pdf[c].notna().any()]
        y, numbers = pdf[value].astype(float).to_numpy(), M.month_numbers(pdf[period])
        x = pdf[columns].astype(float).to_numpy() if columns else None
        there = ~np.isnan(y) & (True if x is None else ~np.isnan(x).any(axis=1))
        months = pd.to_datetime(pdf[period]).dt.strftime("%Y-%m").to_numpy()
        if (np.diff(numbers) <= 0).any():
            out["status"] = "repeated_months"
        elif there.sum() < least + 1 or (cut := split_rows(months[there].tolist(), train_end, test_start, least, test_rows)) is None:
            out["status"] = "insufficient_data"
        else:
            y, numbers, x = y[there], numbers[there], None if x is None else x[there]
            grid = lambda n: A.monthly_grid(numbers[:n], y[:n], np.zeros((n, 0)) if x is None else x[:n])
            train, test = cut
            (past, rows), (every, every_row) = grid(len(train)), grid(len(y))
            after = len(every) - len(past)  # months from the end of training on; those tested are among them
            model = A.fit(past, None if x is None else rows)
            future = None if x is None else np.nan_to_num(every_row[len(past) :])
            got = A.ahead(past, None if x is None else rows, model, after, future)[numbers[test] - numbers[0] - len(past)]
            e, real = got - y[test], y[test]
            use = real != 0
            model = A.fit(every, None if x is None else every_row)
            out |= {"kind": "arima" if x is None else "arimax", **{k: getattr(model, k) for k in ("order", "drift", "phi", "theta", "beta", "variance", "loglik")}}
            out |= {"history": every.tolist(), "rows": [] if x is None else every_row.tolist(), "last_period": pdf[period][there].iloc[-1], "n_train": len(train), "n_test": len(test)}
            out |= {"mae": float(np.abs(e).mean()), "rmse": float(np.sqrt((e**2).mean())), "mape": float(np.abs(e[use] / real[use]).mean() * 100) if use.any() else 0.0}
        names = [key, *(f.split()[0] for f in ARTIFACT.split(", "))]
        return pd.DataFrame([[out.get(n) for n in names]], columns=names)

    return df.select(key, period, value, *exogenous).groupBy(key).applyInPandas(run, f"{key} {kind}, {ARTIFACT}")


def forecast_from(artifacts: DataFrame, key: str, steps: int) -> DataFrame:
    """(key, step, period, predicted) of every series whose artifact is ok, ``steps`` months ahead of its last one."""
    if steps < 1:
        raise ValueError("horizon must be at least 1")
    kind = artifacts.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                x = np.array([list(v) for v in r.rows], float) if len(r.rows) else None
                model = A.Fitted(r.order, r.phi, r.theta, r.drift, list(r.beta))
                got = A.ahead(np.array(r.history, float), x, model, steps)  # exogenous columns keep their last row
                rows += [(getattr(r, key), i + 1, r.last_period, round(float(v), 2)) for i, v in enumerate(got)]
            yield pd.DataFrame(rows, columns=[key, "step", "last_period", "predicted"])

    rows = artifacts.where("status = 'ok'").select(key, "order", "drift", "phi", "theta", "beta", "history", "rows", "last_period").mapInPandas(run, f"{key} {kind}, step long, last_period date, predicted double")
    return rows.select(key, "step", month_after(F.col("last_period"), F.col("step")).alias("period"), "predicted")


def month_after(last: Column, steps: Column) -> Column:
    """The first day of the month so many months after a date's."""
    return F.add_months(F.trunc(last, "MM"), steps.cast("int"))


# --- tree boosters -------------------------------------------------------------------------------------------------


def train_booster(df: DataFrame, target: str, features: list[str], backend: str = "xgboost", train_end: str = TRAIN_END, period: str = "period", least: int = LEAST_TRAIN, trees: int | None = None) -> tuple[str, B.Booster | None, DataFrame | None]:
    """(status, model, predictions of the months after ``train_end``): ok, insufficient_data, or unavailable for a backend that is not here."""
    if backend not in BOOSTERS:
        return "unavailable", None, None
    train = df.where(F.date_format(period, "yyyy-MM") <= train_end).where(F.col(target).isNotNull())
    if train.count() < least:
        return "insufficient_data", None, None
    profile = BOOSTERS[backend]
    model = M.train_trees(train, target, features, profile, trees=trees or profile.trees)
    test = df.where(F.date_format(period, "yyyy-MM") > train_end)
    return "ok", model, B.predicted(test, model).select(*df.columns, F.round("prediction", 4).alias("predicted"))


def save_trees(spark: SparkSession, model: B.Booster, path: str) -> None:
    """The model's nodes and edges and, beside them, a table of its features' gains."""
    B.save(spark, model, path)


def load_trees(spark: SparkSession, path: str) -> tuple[B.Booster, DataFrame]:
    return B.load(spark, path)


# --- all models ----------------------------------------------------------------------------------------------------


def train_all(spark: SparkSession, trainers: dict[str, Callable[[], dict]], timeout: float | None = None, pool: str | None = None) -> DataFrame:
    """(model_name, status, mae, rmse, mape, error) of every trainer, run at once, each in a thread of its own with the caller's job properties.

    One that fails has its error and stops no other. One that takes longer than ``timeout`` seconds is ``timeout``: its Spark jobs are
    cancelled by their tag, and what it does besides is left to end by itself, its result unseen. ``pool`` names the fair-scheduler pool
    of their jobs; each trainer gets one of its own below it, so that a large one does not keep the others waiting.
    """
    sc, run_id = spark.sparkContext, uuid.uuid4().hex
    done: dict[str, tuple] = {}

    def work(name: str, train: Callable[[], dict]) -> None:
        sc.addJobTag(f"{run_id}-{_tag(name)}")
        sc.setLocalProperty("spark.scheduler.pool", f"{pool}-{_tag(name)}" if pool else None)
        try:
            got = train()
            found = (name, got.get("status", "ok"), *(None if got.get(k) is None else float(got[k]) for k in ("mae", "rmse", "mape")), None)
        except Exception as e:  # noqa: BLE001  reported as the model's status
            found = (name, "error", None, None, None, f"{type(e).__name__}: {e}"[:500])
        done.setdefault(name, found)

    threads = {name: InheritableThread(target=work, args=(name, train), daemon=True) for name, train in trainers.items()}
    for t in threads.values():
        t.start()
    end = None if timeout is None else time.monotonic() + timeout
    for name, t in threads.items():
        t.join(None if end is None else max(0.0, end - time.monotonic()))
        if t.is_alive():
            done.setdefault(name, (name, "timeout", None, None, None, f"not done after {timeout} s"))
            sc.cancelJobsWithTag(f"{run_id}-{_tag(name)}")
    return spark.createDataFrame([done[name] for name in trainers], "model_name string, status string, mae double, rmse double, mape double, error string")


def _tag(name: str) -> str:
    """A name as part of a job tag, which may hold no comma."""
    return name.replace(",", ";")


def forecast(spark: SparkSession, forecasters: dict[str, Callable[[int], Sequence[float]]], name: str, last_period, horizon: int = 6) -> DataFrame:
    """(model, step, period, predicted_value) from the named model for the ``horizon`` months after ``last_period``.

    An unknown name, one without a trained model, a horizon below 1 or beyond the model's own, and forecasts of another length
    are errors: nothing is invented.
    """
    name = name.strip().lower()
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    if name not in MOST_AHEAD:
        raise ValueError(f"unknown model {name!r}; use one of {', '.join(MOST_AHEAD)}")
    if (most := MOST_AHEAD[name]) and horizon > most:
        raise ValueError(f"{name} forecasts {most} months at most, not {horizon}")
    if name not in forecasters:
        raise LookupError(f"no trained model {name}")
    values = [float(v) for v in forecasters[name](horizon)]
    if len(values) != horizon:
        raise ValueError(f"{name} gave {len(values)} values for {horizon} months")
    rows = spark.createDataFrame([(name, i, v) for i, v in enumerate(values, 1)], "model string, step long, value double")
    return rows.select("model", "step", month_after(F.lit(last_period).cast("date"), F.col("step")).alias("period"), F.round("value", 2).alias("predicted_value"))
