"""A small recurrent forecaster over the windows of all series: one LSTM layer, gradients added up over tasks once an epoch.

Twelve scaled values in, the next six out at once. A series is scaled by mean and deviation of its training rows alone. Windows of all
series are stored in a fixed number of parts, dealt by hash; an epoch is one job in which each part gives its sum of errors and one
gradient (some ten thousand numbers), and one step of Adam over all windows follows. Parts, their order and the start are the same in
each run and on any partitioning of the input, and so are the weights, up to the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch_folder, stored

#: Values in, values out, hidden units, epochs.
LENGTH, HORIZON, HIDDEN, EPOCHS = 12, 6, 32, 40
#: Parts of the windows; Adam's rate; seed of the start.
PARTS, RATE, SEED = 8, 0.02, 42
Weights = dict[str, np.ndarray]


def start(hidden: int = HIDDEN, horizon: int = HORIZON, seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    w = {"x": rng.normal(size=4 * hidden) * 0.3, "h": rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden), "b": np.zeros(4 * hidden), "out": rng.normal(size=(hidden, horizon)) / np.sqrt(hidden), "c": np.zeros(horizon)}
    w["b"][hidden : 2 * hidden] = 1.0  # cells remember at first
    return w


def _gates(w: Weights, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    a = x[:, None] * w["x"] + h @ w["h"] + w["b"]
    n = h.shape[1]
    squash = lambda v: 1 / (1 + np.exp(-v))
    return squash(a[:, :n]), squash(a[:, n : 2 * n]), squash(a[:, 2 * n : 3 * n]), np.tanh(a[:, 3 * n :])


def predict(w: Weights, x: np.ndarray) -> np.ndarray:
    """The next values of scaled windows, one window a row."""
    h = c = np.zeros((len(x), w["h"].shape[0]))
    for t in range(x.shape[1]):
        i, f, o, g = _gates(w, x[:, t], h)
        c = f * c + i * g
        h = o * np.tanh(c)
    return h @ w["out"] + w["c"]


def loss(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Sum of squared errors over windows, and its gradient by going back through time."""
    hs, cs, gates = [np.zeros((len(x), w["h"].shape[0]))], [np.zeros((len(x), w["h"].shape[0]))], []
    for t in range(x.shape[1]):
        i, f, o, g = _gates(w, x[:, t], hs[-1])
        cs.append(f * cs[-1] + i * g)
        hs.append(o * np.tanh(cs[-1]))
        gates.append((i, f, o, g))
    e = hs[-1] @ w["out"] + w["c"] - y
    d = {k: np.zeros_like(v) for k, v in w.items()}
    d["out"], d["c"] = 2 * hs[-1].T @ e, 2 * e.sum(axis=0)
    dh, dc = 2 * e @ w["out"].T, 0.0
    for t in range(x.shape[1] - 1, -1, -1):
        (i, f, o, g), tc = gates[t], np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        a = np.concatenate([dc * g * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d["x"] += x[:, t] @ a
        d["h"] += hs[t].T @ a
        d["b"] += a.sum(axis=0)
        dh, dc = a @ w["h"].T, dc * f
    return float((e * e).sum()), d


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(v: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def numbered(df: DataFrame, key: str, value: str, period: str, test_rows: int) -> DataFrame:
    """(key, at, v, n, total, mean, std): rows of each series with their number and the scale of its training rows."""
    w = Window.partitionBy("key")
    rows = df.select(F.col(key).alias("key"), F.col(period).alias("at"), F.col(value).cast("double").alias("v")).withColumns({"n": F.row_number().over(w.orderBy("at")), "total": F.count("*").over(w)})
    train = F.when(F.col("n") <= F.col("total") - test_rows, F.col("v"))
    std = F.stddev_pop(train).over(w)
    return rows.withColumns({"mean": F.avg(train).over(w), "std": F.when(std > 0, std).otherwise(1.0)})


def windows(rows: DataFrame, length: int, horizon: int, test_rows: int) -> DataFrame:
    """(key, n, x, y): scaled windows whose values are all there and lie before the test rows."""
    w = Window.partitionBy("key").orderBy("n")
    z = (F.col("v") - F.col("mean")) / F.col("std")
    own = rows.where(F.col("n") <= F.col("total") - test_rows).withColumn("z", z)
    pairs = own.select("key", "n", F.collect_list("z").over(w.rowsBetween(1 - length, 0)).alias("x"), F.collect_list("z").over(w.rowsBetween(1, horizon)).alias("y"))
    return pairs.where((F.size("x") == length) & (F.size("y") == horizon))  # nulls make a window shorter


def fit(pairs: DataFrame, epochs: int = EPOCHS, hidden: int = HIDDEN, rate: float = RATE, seed: int = SEED, horizon: int = HORIZON) -> tuple[Weights, list[float]]:
    """(weights, mean squared error of each epoch) of windows (key, n, x, y); without any window the start and no errors."""
    like = start(hidden, horizon, seed)
    with scratch_folder(pairs.sparkSession) as folder:
        dealt = stored(pairs.repartition(PARTS, F.xxhash64("key", "n")).sortWithinPartitions("key", "n"), f"{folder}/windows")
        n = dealt.count()
        v, mean, square, errors = _flat(like), 0.0, 0.0, []
        for epoch in range(1, epochs + 1 if n else 1):
            w = _shaped(v, like)

            def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
                total, gradient = 0.0, np.zeros(sum(p.size for p in w.values()))
                for b in batches:
                    if b.num_rows:
                        x, y = (b.column(i).flatten().to_numpy().reshape(b.num_rows, -1) for i in (0, 1))
                        part, d = loss(w, x, y)
                        total, gradient = total + part, gradient + _flat(d)
                yield pa.RecordBatch.from_pydict({"total": [total], "gradient": [gradient.tobytes()]})

            parts = dealt.select("x", "y").mapInArrow(run, "total double, gradient binary").collect()  # one for each part
            errors.append(sum(sorted(p.total for p in parts)) / n / horizon)
            g = sum(np.frombuffer(p.gradient) for p in sorted(parts, key=lambda p: p.total)) / n
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            v = v - rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    return _shaped(v, like), errors


def forecast(df: DataFrame, key: str, value: str = "value", period: str = "period", length: int = LENGTH, horizon: int = HORIZON, test_rows: int = HORIZON, epochs: int = EPOCHS, hidden: int = HIDDEN) -> DataFrame:
    """(key, status, step, predicted, mape): the steps after each series' end, and the error on its last ``test_rows``, which no weight or scale has seen.

    A series without a whole window before its test rows, or without its last values, has the status insufficient_data. Zero actuals are
    left out of the error, which is 0 where all are.
    """
    rows = numbered(df, key, value, period, test_rows)
    weights, _ = fit(windows(rows, length, horizon, test_rows), epochs, hidden, horizon=horizon)
    w = Window.partitionBy("key").orderBy("n").rowsBetween(1 - length, 0)
    seen = rows.withColumn("x", F.collect_list("v").over(w))
    row = lambda at, c: F.max(F.when(F.col("n") == F.col("total") - at, F.col(c)))
    ends = seen.groupBy("key").agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("total").alias("total"), row(0, "x").alias("last"), row(test_rows, "x").alias("before"), F.array(*(row(test_rows - 1 - i, "v") for i in range(test_rows))).alias("actual"))

    @F.pandas_udf("struct<status:string,predicted:array<double>,mape:double>")
    def ahead(mean: pd.Series, std: pd.Series, total: pd.Series, last: pd.Series, before: pd.Series, actual: pd.Series) -> pd.DataFrame:
        out = []
        for m, s, n, a, b, real in zip(mean, std, total, last, before, actual, strict=True):
            if n < length + horizon + test_rows or a is None or b is None or len(a) < length or len(b) < length:
                out.append(("insufficient_data", None, None))
                continue
            later, tested = (predict(weights, (np.array(z, float)[None, :] - m) / s)[0] * s + m for z in (a, b))
            y = np.array([np.nan if v is None else v for v in real], float)[:horizon]
            use = ~np.isnan(y) & (y != 0)
            out.append(("ok", np.round(later, 2).tolist(), round(float(np.abs((tested[: len(y)][use] - y[use]) / y[use]).mean() * 100), 4) if use.any() else 0.0))
        return pd.DataFrame(out, columns=["status", "predicted", "mape"])

    found = ends.select("key", ahead("mean", "std", "total", "last", "before", "actual").alias("f"))
    steps = found.select("key", "f.status", "f.mape", F.posexplode_outer("f.predicted").alias("i", "predicted"))
    return steps.select(F.col("key").alias(key), "status", (F.col("i") + 1).cast("long").alias("step"), "predicted", "mape")
