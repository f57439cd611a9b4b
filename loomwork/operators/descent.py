"""Minimising a function whose value and gradient come from Spark: each call may be one job that adds up tasks' parts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, most_calls: int = 60, memory: int = 10, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(place, value) where a smooth function is least, by limited-memory BFGS with steps halved until the value falls enough.

    Ends when the gradient's largest component is at most ``tolerance`` times that at the start, or after ``most_calls`` calls.
    """
    x = np.array(start, dtype=np.float64)
    value, gradient = value_and_gradient(x)
    calls, first = 1, np.abs(gradient).max(initial=0)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while calls < most_calls and np.abs(gradient).max(initial=0) > tolerance * first:
        direction, shares = -gradient, []
        for s, y in reversed(steps):
            shares.append((s @ direction) / (s @ y))
            direction = direction - shares[-1] * y
        direction = direction * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(gradient)))
        for (s, y), share in zip(steps, reversed(shares), strict=True):
            direction = direction + (share - (y @ direction) / (s @ y)) * s
        slope, length = gradient @ direction, 1.0
        while calls < most_calls:
            there = x + length * direction
            new_value, new_gradient = value_and_gradient(there)
            calls += 1
            if np.isfinite(new_value) and new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = there - x, new_gradient - gradient
        if s @ y > 1e-10 * (y @ y):
            steps = [*steps[-memory + 1 :], (s, y)]
        x, value, gradient = there, new_value, new_gradient
    return x, value
