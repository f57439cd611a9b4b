"""Histogram boosting against exhaustive splits, on one task and level by level."""

from dataclasses import replace

import numpy as np
import pytest

from loomwork.operators import boosting as B


def table(n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n).astype(float), rng.normal(size=n).round(2), np.full(n, 4.0)], axis=1)
    x[rng.random(n) < 0.25, 0] = np.nan
    x[rng.random(n) < 0.1, 1] = np.nan
    y = np.where(np.isnan(x[:, 0]), 6.0, x[:, 0]) + np.where(np.nan_to_num(x[:, 1]) > 0.3, 4.0, 0.0) + rng.normal(size=n) * 0.1
    return x, y


def frame(spark, x, y):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t), "odd") for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, prediction string")


def exhaustive(x, g, rows, p, depth, number=1, tree=None):
    """The tree by trying every value of every feature with the nulls on either side."""
    tree = {} if tree is None else tree
    total, n = g[rows].sum(), len(rows)
    tree[number] = (None, -p.rate * total / (n + p.squares), 0.0)
    best = None
    if depth < p.depth:
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j][~np.isnan(x[rows, j])])
            for cut in [*(values[:-1] + values[1:]) / 2, np.inf]:  # at last the nulls alone
                for side in (False, True):
                    left = np.where(np.isnan(x[rows, j]), side, x[rows, j] <= cut)
                    gl, nl = g[rows][left].sum(), left.sum()
                    if nl < p.least_rows or n - nl < p.least_rows:
                        continue
                    gain = (gl**2 / (nl + p.squares) + (total - gl) ** 2 / (n - nl + p.squares) - total**2 / (n + p.squares)) / 2
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, j, left)
    if best:
        gain, j, left = best
        tree[number] = (j, tree[number][1], gain)
        exhaustive(x, g, rows[left], p, depth + 1, 2 * number, tree)
        exhaustive(x, g, rows[~left], p, depth + 1, 2 * number + 1, tree)
    return tree


@pytest.mark.parametrize("one_task", [B.ONE_TASK, 0])
def test_trees_equal_exhaustive_splits(spark, one_task):
    x, y = table()
    p = B.Profile(trees=2, depth=3, rate=0.5)
    got = B.fit(frame(spark, x, y).repartition(3), "y", ["a", "b", "c"], p, one_task=one_task)
    so_far = np.full(len(y), y.mean())
    for tree in got.trees:
        want = exhaustive(x, so_far - y, np.arange(len(y)), p, 0)
        assert set(tree) == set(want)
        for number, (j, value, gain) in want.items():
            assert (tree[number].feature if tree[number].feature >= 0 else None) == j
            assert tree[number].value == pytest.approx(value) and tree[number].gain == pytest.approx(gain)
        so_far += np.array([want[n][1] for n in B.placed(B.binned(x, got.edges), tree)])
    assert got.predicted(B.binned(x, got.edges)) == pytest.approx(so_far)


def test_both_ways_give_one_model(spark, monkeypatch):
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    x, y = table(400, 1)
    p = B.Profile(trees=5, depth=3)
    df = frame(spark, x, y)
    a, b = (B.fit(df.repartition(n), "y", ["a", "b"], p, one_task=k) for n, k in ((2, B.ONE_TASK), (5, 0)))
    assert a.predicted(B.binned(x[:, :2], a.edges)) == pytest.approx(b.predicted(B.binned(x[:, :2], b.edges)))


def test_nulls_go_where_they_gain(spark):
    rows = [(1.0, 0.0), (2.0, 0.0), (3.0, 9.0), (None, 9.0), (float("nan"), 9.0)] * 8
    for high in (True, False):
        df = spark.createDataFrame([(a, y if high or a == a and a is not None else 0.0) for a, y in rows], "a double, y double")
        got = B.fit(df, "y", ["a"], B.Profile(trees=1, depth=1, rate=1.0, squares=0.0))
        assert got.trees[0][1].null_left is not high
        out = {r.a if r.a == r.a else None: r.p for r in B.predicted(df, got, "p").collect()}
        assert out[None] == pytest.approx(9.0 if high else 0.0) and out[1.0] == pytest.approx(0.0)


def test_leaves_are_split_by_gain(spark):
    x, y = table(300, 2)
    full = B.Profile(trees=1, depth=4, rate=1.0, least_rows=20, squares=0.0)
    grown = B.fit(frame(spark, x, y), "y", ["a", "b"], full).trees[0]
    for leaves in (1, 2, 4, 6):
        tree = B.fit(frame(spark, x, y), "y", ["a", "b"], replace(full, leaves=leaves)).trees[0]
        inner = [n for n in tree if tree[n].feature >= 0]
        assert len(inner) == leaves - 1 and all(tree[n].rows >= 20 for n in tree)
        open_nodes, taken = [1], []
        while len(taken) < leaves - 1:  # by hand: the open leaf of largest gain
            n = max(open_nodes, key=lambda n: grown[n].gain)
            open_nodes = [m for m in open_nodes if m != n] + [2 * n, 2 * n + 1]
            taken.append(n)
        assert sorted(inner) == sorted(taken)


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 1))
    df = spark.createDataFrame([(float(v), float(v > 1.2)) for v in x[:, 0]], "a double, y double")
    got = B.fit(df, "y", ["a"], B.Profile(trees=20, depth=2, rate=0.5))
    assert len(got.edges[0]) <= B.BINS
    wrong = np.abs(got.predicted(B.binned(x, got.edges)) - (x[:, 0] > 1.2)) > 0.5
    assert wrong.mean() < 0.01


def test_edges(spark):
    df = frame(spark, *table(30))
    none = B.fit(df.where("false"), "y", ["a", "b"])
    assert none.trees == [] and B.predicted(df, none).select("prediction").distinct().collect()[0][0] == 0.0
    flat = B.fit(df, "y", ["c"], B.Profile(trees=2))
    assert [len(t) for t in flat.trees] == [1, 1] and B.importances(flat) == []
    empty = df.selectExpr("cast(null as double) a", "y")
    assert [len(t) for t in B.fit(empty, "y", ["a"], B.Profile(trees=1)).trees] == [1]
    only_null = df.selectExpr("case when y > 5 then 1.0D end a", "y")  # one value and null: all values left, nulls right
    got = B.fit(only_null, "y", ["a"], B.Profile(trees=1, depth=1, rate=1.0, squares=0.0))
    assert len(got.trees[0]) == 3 and B.node_table(spark, got).where("node = 1").first().threshold is None
    assert B._trees(B.node_rows(got), got) == got.trees


def test_round_trip(spark, tmp_path):
    x, y = table()
    got = B.fit(frame(spark, x, y), "y", ["a", "b", "c"], B.Profile(trees=4))
    B.save(spark, got, str(tmp_path / "m"))
    again, gains = B.load(spark, str(tmp_path / "m"))
    assert again.trees == got.trees
    ranked = [r.gain for r in gains.orderBy("place").collect()]
    assert ranked == sorted(ranked, reverse=True) and "c" not in {r.feature for r in gains.collect()}
    row = {"a": None, "b": 0.5, "c": 4.0}
    assert B.predict_one(again, row) == pytest.approx(float(got.predicted(B.binned(np.array([[np.nan, 0.5, 4.0]]), got.edges))[0]))
