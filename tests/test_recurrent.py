"""The recurrent forecaster: gradient, partitions, scale, and errors beside the ridge's."""

import datetime as dt

import numpy as np
import pytest

from loomwork.operators import models as M
from loomwork.operators import recurrent as R


def month(i):
    return dt.date(2015 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def monthly(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{k}", month(i), float(1000 * (k + 1) * (1 + 0.3 * np.sin(2 * np.pi * (i + k) / 12)) + rng.normal() * 10 * (k + 1))) for k in range(6) for i in range(84)]
    rows += [("short", month(i), 1.0) for i in range(20)] + [("hole", month(i), float(i) if i != 82 else None) for i in range(84)] + [("flat", month(i), 7.0) for i in range(40)]
    return spark.createDataFrame(rows, "k string, period date, value double").cache()


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    w, x, y = R.start(hidden=5, horizon=3), rng.normal(size=(7, 6)), rng.normal(size=(7, 3))
    value, d = R.loss(w, x, y)
    assert value == pytest.approx(((R.predict(w, x) - y) ** 2).sum())
    v, g = R._flat(w), R._flat(d)
    for i in range(len(v)):
        step = np.zeros_like(v)
        step[i] = 1e-6
        assert g[i] == pytest.approx((R.loss(R._shaped(v + step, w), x, y)[0] - R.loss(R._shaped(v - step, w), x, y)[0]) / 2e-6, rel=1e-4, abs=1e-6)


def test_weights_do_not_depend_on_partitions(monthly):
    fits = [R.fit(R.windows(R.numbered(monthly.repartition(n), "k", "value", "period", 6), 12, 6, 6), epochs=3, hidden=8) for n in (1, 5)]
    assert all(np.allclose(fits[0][0][k], fits[1][0][k], atol=1e-10) for k in fits[0][0])
    assert fits[0][1][-1] < fits[0][1][0]


def test_scale_is_of_training_rows(monthly):
    changed = monthly.selectExpr("k", "period", "CASE WHEN period >= '2021-07-01' THEN value * 50 ELSE value END AS value")
    of = lambda df: {r.k: (r.mean, r.std) for r in R.numbered(df, "k", "value", "period", 6).where("key LIKE 's_'").selectExpr("key AS k", "mean", "std").distinct().collect()}
    assert of(monthly) == of(changed)


def test_forecast_and_errors(monthly):
    got = {}
    for r in R.forecast(monthly, "k", epochs=120).collect():
        got.setdefault(r.k, []).append(r)
    assert {k: v[0].status for k, v in got.items()} == {**{f"s{k}": "ok" for k in range(6)}, "short": "insufficient_data", "hole": "insufficient_data", "flat": "ok"}
    assert all([r.step for r in sorted(v, key=lambda r: r.step)] == list(range(1, 7)) for v in got.values() if v[0].status == "ok")
    ridge = {r.k: r.mape for r in M.window_forecast(monthly, "k").where("status = 'ok'").collect()}
    mine = np.mean([got[f"s{k}"][0].mape for k in range(6)])
    assert mine < 8 and np.mean([ridge[f"s{k}"] for k in range(6)]) < 8, (mine, ridge)


def test_nothing_to_learn_from(spark, monthly):
    assert R.forecast(monthly.where("false"), "k").isEmpty()
    assert {r.status for r in R.forecast(monthly.where("k = 'short'"), "k").collect()} == {"insufficient_data"}
