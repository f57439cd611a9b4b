"""ARIMA(1, 1, 1) of short monthly series by exact likelihood: a Kalman filter with missing months, regression and errors fitted together.

The series is a level that starts at its first value, a drift, a regression and increments that are a stationary ARMA(1, 1). The
filter runs over all months; where one is missing it only predicts. Values, drift and columns go through the same filter, so the
regression is the generalised least squares one under the errors' own covariance, and the likelihood is that of the values given
the first one. It is concentrated on the two ARMA parameters and climbed from several starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .descent import minimise

#: Largest size of either parameter, starts of the search, and calls of each.
LARGEST, STARTS, CALLS = 0.99, ((0.0, 0.0), (0.6, -0.3), (-0.5, 0.4)), 40


@dataclass
class Fitted:
    order: str
    phi: float
    theta: float
    drift: float
    beta: list[float] = field(default_factory=list)
    variance: float = 0.0
    loglik: float = float("-inf")


def filtered(z: np.ndarray, there: np.ndarray, phi: float, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Innovations of each column of ``z`` at the months that are ``there``, their variances (for noise of 1), and the last state.

    State: level, increment, theta times noise. The first month must be there; it sets the level and has no innovation.
    """
    step = np.array([[1.0, phi, 1.0], [0.0, phi, 1.0], [0.0, 0.0, 0.0]])  # the next increment moves the level with it
    noise = np.outer(v := np.array([1.0, 1.0, theta]), v)
    spread = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    p = np.array([[0.0, 0.0, 0.0], [0.0, spread, theta], [0.0, theta, theta * theta]])
    state = np.zeros((3, z.shape[1]))
    state[0] = z[0]
    innovations, variances = [], []
    for t in range(1, len(z)):
        state, p = step @ state, step @ p @ step.T + noise
        if there[t]:
            f, gain = p[0, 0], p[:, 0] / p[0, 0]
            innovation = z[t] - state[0]
            innovations.append(innovation)
            variances.append(f)
            state = state + np.outer(gain, innovation)
            p = p - np.outer(gain, p[0])
    return np.array(innovations).reshape(-1, z.shape[1]), np.array(variances), state


def profile(z: np.ndarray, there: np.ndarray, phi: float, theta: float) -> tuple[float, np.ndarray, float]:
    """(log-likelihood, coefficients, variance) at two parameters, coefficients and variance being the best ones there.

    The first column of ``z`` is the series, the others what it is regressed on.
    """
    e, f, _ = filtered(z, there, phi, theta)
    scaled = e / np.sqrt(f)[:, None]
    beta = np.linalg.lstsq(scaled[:, 1:], scaled[:, 0], rcond=None)[0] if z.shape[1] > 1 else np.zeros(0)
    rest = scaled[:, 0] - scaled[:, 1:] @ beta
    n = len(rest)
    variance = max(float(rest @ rest) / n, 1e-12)
    return -n / 2 * (np.log(2 * np.pi * variance) + 1) - np.log(f).sum() / 2, beta, variance


def columns(y: np.ndarray, x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The series, time and regressors from the first month that is there, 0 where missing; and which months are there."""
    there = ~np.isnan(y)
    if x is not None:
        there &= ~np.isnan(x).any(axis=1)
    start = int(there.argmax())
    z = np.column_stack([y, np.arange(len(y), dtype=float), *([] if x is None else [x])])[start:]
    there = there[start:]
    return np.where(there[:, None], z, 0.0), there


def fit(y: np.ndarray, x: np.ndarray | None = None) -> Fitted:
    """The likeliest model; theta is left out where it gains less than AIC asks. NaN in ``y``, or in a row of ``x``, is a missing month."""
    z, there = columns(y, x)
    if there.sum() < 4 + z.shape[1]:
        raise ValueError("too few months")

    def best(free: int) -> tuple[float, float, float]:
        place = lambda u: np.append(LARGEST * np.tanh(u), 0.0)[:2] if free == 1 else LARGEST * np.tanh(u)

        def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
            f = lambda u: -profile(z, there, *place(u))[0]
            h = 1e-5
            return f(u), np.array([(f(u + d) - f(u - d)) / (2 * h) for d in np.eye(free) * h])

        found = [minimise(loss, np.arctanh(np.array(s[:free]) / LARGEST), CALLS, tolerance=1e-6) for s in STARTS]
        u, value = min(found, key=lambda r: r[1])
        return -value, *map(float, place(u))

    full, plain = best(2), best(1)
    (loglik, phi, theta), order = (full, "1,1,1") if full[0] - plain[0] > 1 else (plain, "1,1,0")
    loglik, beta, variance = profile(z, there, phi, theta)
    return Fitted(order, phi, theta, float(beta[0]), [float(b) for b in beta[1:]], variance, float(loglik))


def ahead(y: np.ndarray, x: np.ndarray | None, m: Fitted, steps: int, future: np.ndarray | None = None) -> np.ndarray:
    """The expected next values; regressors keep their last whole row where ``future`` does not give them."""
    z, there = columns(y, x)
    coefficients = np.array([m.drift, *m.beta])
    _, _, state = filtered(np.where(there, z[:, 0] - z[:, 1:] @ coefficients, 0.0)[:, None], there, m.phi, m.theta)
    level, increment, carried = state[:, 0]
    last = None if x is None else (x[~np.isnan(x).any(axis=1)][-1:] if future is None else future)
    out = []
    for i in range(steps):
        increment, carried = m.phi * increment + carried, 0.0
        level += increment
        out.append(level + m.drift * (len(z) + i) + (0.0 if last is None else float(last[min(i, len(last) - 1)] @ np.array(m.beta))))
    return np.array(out)


def monthly_grid(months: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (NaN where there is none) for each month from the first to the last of ascending month numbers, each no more than once."""
    if len(months) and (np.diff(months) <= 0).any():
        raise ValueError("months must ascend")
    at = months - months[0] if len(months) else months
    n = int(at[-1]) + 1 if len(at) else 0
    out = []
    for r in rows:
        grid = np.full((n, *r.shape[1:]), np.nan)
        grid[at] = r
        out.append(grid)
    return tuple(out)
