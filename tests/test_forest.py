"""One forest over all series against a forest in one process."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import forest as R


def frame(spark, n=150):
    rng = np.random.default_rng(1)
    rows = []
    for k in "abc":
        v = 100 + rng.normal(size=n).cumsum()
        v[n // 2] += 60 if k != "c" else 0
        rows += [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x) if i != 20 else None) for i, x in enumerate(v)]
    rows += [("short", dt.date(2020, 1, 1 + i), 1.0) for i in range(10)] + [("zero", dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(30)]
    return spark.createDataFrame(rows, "k string, period date, value double")


def single(rows, hashes, trees, size, seed):
    """Scores by walking each row down each tree, samples taken by sorting all hashes."""
    x = np.array([[r[f] for f in R.FEATURES] for r in rows])
    forest = []
    for t in range(trees):
        order = sorted(range(len(rows)), key=lambda i: (hashes[i][t], rows[i].key, rows[i]["at"]))[:size]
        forest.append(R.grow(x[order], seed, t))

    def depth(row, tree):
        feature, cut, left, leaf = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] + int(row[feature[at]] >= cut[at])
        return leaf[at]

    return -np.exp2(-np.array([np.mean([depth(row, t) for t in forest]) for row in x]) / R.expected(min(size, len(rows))))


@pytest.mark.parametrize("size", [16, 256, 4096])
def test_scores_equal_one_process(spark, size):
    df = frame(spark)
    rows = R.series_features(df, "k")
    trees, seed = 12, 7
    known = rows.withColumn("hashes", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64("key", "at", F.lit(seed), t))).collect()
    raw = single(known, [r.hashes for r in known], trees, size, seed)
    offset = np.percentile(raw, 5)
    got = {(r.k, r.period): (r.score, r.is_anomaly) for r in R.anomalies(df.repartition(5), "k", trees=trees, size=size, seed=seed).collect()}
    assert len(got) == len(known)
    for r, s in zip(known, raw, strict=True):
        score, flag = got[r.key, r["at"]]
        assert score == pytest.approx(s - offset, abs=2e-6) and (flag == (s < offset) or abs(s - offset) < 1e-8)


def test_planted_points_stand_out(spark):
    got = R.anomalies(frame(spark), "k").collect()
    assert {r.k for r in got} == {"a", "b", "c"}  # too few rows; no change from nothing
    flagged = {(r.k, r.period) for r in got if r.is_anomaly}
    planted = dt.date(2020, 1, 1) + dt.timedelta(days=75)
    assert {("a", planted), ("b", planted)} <= flagged and len(flagged) <= 0.06 * len(got)


def test_samples_are_bounded_and_whole(spark):
    rows = R.series_features(frame(spark, 2000), "k")
    total = rows.count()
    s = R.samples(rows, total, 20, 64, 3)
    assert {r["count"] for r in s.groupBy("tree").count().collect()} == {64} and s.select("tree").distinct().count() == 20
    assert R.anomalies(frame(spark).where("false"), "k").isEmpty()
