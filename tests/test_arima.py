"""Exact likelihood of ARIMA with missing months against the dense Gaussian one."""

import datetime as dt

import numpy as np
import pytest

from loomwork.operators import arima as A
from loomwork.operators import models as M


def simulated(n, phi=0.6, theta=-0.3, drift=0.5, seed=0):
    rng = np.random.default_rng(seed)
    e, u, y = rng.normal(size=n + 50), 0.0, [100.0]
    for t in range(1, n + 50):
        u = phi * u + e[t] + theta * e[t - 1]
        if t >= 51:
            y.append(y[-1] + drift + u)
    return np.array(y)


def dense(z, there, phi, theta):
    """Log-likelihood by the covariance of the increments' sums, regression by generalised least squares."""
    n = len(z)
    gamma = np.zeros(n)
    gamma[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    for k in range(1, n):
        gamma[k] = phi * gamma[k - 1] + (theta if k == 1 else 0.0)
    cov = np.array([[gamma[abs(i - j)] for j in range(n - 1)] for i in range(n - 1)])
    sums = np.tril(np.ones((n - 1, n - 1)))
    keep = np.flatnonzero(there[1:])
    c = (sums @ cov @ sums.T)[np.ix_(keep, keep)]
    d = (z - z[0])[1:][keep]
    w = np.linalg.inv(c)
    x, y = d[:, 1:], d[:, 0]
    beta = np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
    rest = y - x @ beta
    m = len(y)
    s = rest @ w @ rest / m
    return -m / 2 * (np.log(2 * np.pi * s) + 1) - np.linalg.slogdet(c)[1] / 2, beta, s


@pytest.mark.parametrize(("phi", "theta"), [(0.0, 0.0), (0.7, -0.4), (-0.5, 0.8), (0.95, 0.5)])
@pytest.mark.parametrize("missing", [(), (3, 4, 11), (0, 1, 19)])
def test_likelihood_equals_the_dense_one(phi, theta, missing):
    y = simulated(20)
    x = np.random.default_rng(1).normal(size=(20, 1)).cumsum(axis=0)
    y[list(missing)] = np.nan
    z, there = A.columns(y, x)
    got, want = A.profile(z, there, phi, theta), dense(z, there, phi, theta)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2])


def test_fit_is_the_top_of_the_likelihood():
    y = simulated(150)
    y[[5, 40, 41, 42]] = np.nan
    m = A.fit(y)
    z, there = A.columns(y, None)
    best = max(A.profile(z, there, p, t)[0] for p in np.linspace(-0.95, 0.95, 39) for t in (np.linspace(-0.95, 0.95, 39) if m.order == "1,1,1" else [0.0]))
    assert m.loglik >= best - 1e-3
    assert m.loglik == pytest.approx(dense(z, there, m.phi, m.theta)[0])


def test_regression_and_errors_together():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2)).cumsum(axis=0)
    y = simulated(90, 0.5, 0.2, 0.1, 4) * 0.2 + x @ [3.0, -2.0]
    x[10, 1] = np.nan
    m = A.fit(y, x)
    assert m.beta == pytest.approx([3.0, -2.0], abs=0.15)
    future = np.zeros((3, 2))
    assert A.ahead(y, x, m, 3, future) + np.tile(x[-1] @ m.beta, 3) == pytest.approx(A.ahead(y, x, m, 3))


def test_forecast_is_the_conditional_mean():
    """Months that are missing at the end are forecast alike: by leaving them out, and by asking for later ones."""
    y = simulated(60)
    m = A.fit(y)
    cut = np.append(y[:-4], [np.nan] * 4)
    assert A.ahead(cut, None, m, 2) == pytest.approx(A.ahead(y[:-4], None, m, 6)[4:])
    z, there = A.columns(y, None)
    rest = (z[:, 0] - m.drift * z[:, 1])[:, None]
    e, _, _ = A.filtered(rest, there, m.phi, m.theta)  # each innovation is the value less its forecast
    assert [y[t] - A.ahead(y[:t], None, m, 1)[0] for t in (10, 30, 59)] == pytest.approx([e[t - 1, 0] for t in (10, 30, 59)])


def test_series_with_gaps(spark):
    month = lambda i: dt.date(2018 + i // 12, i % 12 + 1, 1)
    y = simulated(48)
    rows = [("gap", month(i), float(v) if i != 7 else None) for i, v in enumerate(y) if i not in (20, 21)] + [("twice", month(0), 1.0)] * 30 + [("short", month(i), 1.0) for i in range(5)] + [("flat", month(i), 5.0) for i in range(30)]
    got = {}
    for r in M.arima(spark.createDataFrame(rows, "k string, period date, value double"), "k", steps=3).collect():
        got.setdefault(r.k, []).append(r)
    assert {k: v[0].status for k, v in got.items()} == {"gap": "ok", "twice": "repeated_months", "short": "insufficient_data", "flat": "ok"}
    holed = y.copy()
    holed[[7, 20, 21]] = np.nan
    assert [r.predicted for r in got["gap"]] == np.round(A.ahead(holed, None, A.fit(holed), 3), 2).tolist()
    assert [r.predicted for r in got["flat"]] == [5.0] * 3
