"""Pruned cosines against all pairs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.operators import cosine as C
from loomwork.operators import text as X


def names():
    words = ["led", "lamp", "milk", "fresh", "steel", "pipe", "paper", "common"]
    rows = [(i, " ".join([words[i % 7], words[(i * 3) % 7], f"x{i % 11}", "common" * (i % 3 > 0)])) for i in range(60)]
    return [*rows, *((100 + i, "common goods") for i in range(40)), (200, ""), (201, None), (202, "common"), (203, "qqq zzz")]


def brute(rows):
    """Cosines of all pairs from counts in plain Python."""
    grams = {}
    for i, t in rows:
        g = Counter(w[a : a + n] for w in (f" {w} " for w in (t or "").split()) for n in (3, 4, 5) for a in range(len(w) - n + 1))
        if g:
            grams[i] = g
    df = Counter(t for g in grams.values() for t in g)
    n = len(rows)
    vectors = {i: {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in g.items()} for i, g in grams.items()}
    unit = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in vectors.items()}
    return {(a, b): round(sum(w * unit[b].get(t, 0.0) for t, w in unit[a].items()), 9) for a in unit for b in unit}


@pytest.fixture(scope="module")
def data(spark):
    rows = names()
    df = spark.createDataFrame(rows, "id long, t string")
    weights = X.tfidf(df, "id", X.ngrams(F.col("t")), corpus_size=len(rows))
    return weights.cache(), brute(rows)


@pytest.mark.parametrize("least", [0.95, 0.6, 0.25])
def test_pairs_equal_all_pairs(data, least):
    weights, every = data
    got = {(r.id, r.other): r.cosine for r in C.similar_pairs(weights, weights.withColumnRenamed("id", "other"), ("id", "other"), least).collect()}
    want = {p: c for p, c in every.items() if c >= least}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-8 for p in want)


@pytest.mark.parametrize("but_self", [False, True])
@pytest.mark.parametrize("k", [1, 5, 70])
def test_top_equals_all_pairs(data, k, but_self):
    weights, every = data
    got = {}
    for r in C.top_cosines(weights, weights.withColumnRenamed("id", "other"), ("id", "other"), k, but_self).collect():
        got.setdefault(r.id, {})[r.place] = (r.other, r.cosine)
    for a in {a for a, _ in every}:
        want = sorted(((-round(c, 8), b) for (x, b), c in every.items() if x == a and c > 0 and not (but_self and a == b)))[:k]
        mine = got.get(a, {})
        assert sorted(mine) == list(range(1, len(want) + 1)) and [mine[i][0] for i in sorted(mine)] == [b for _, b in want]
        assert all(abs(mine[i + 1][1] + c) < 1e-7 for i, (c, _) in enumerate(want))


def test_copies_and_hot_terms_open_few_rows(spark):
    """Vectors that share one hot term and have a rare one each: the hot term is opened for none."""
    rows = [(i, t, w) for i in range(300) for t, w in (("hot", 0.3), (f"rare{i // 2}", math.sqrt(1 - 0.09)))]
    v = spark.createDataFrame(rows, "id long, term string, weight double")
    seen = []
    real = C.dots
    C.dots = lambda pairs, a, b: (seen.append(pairs.count()), real(pairs, a, b))[1]
    try:
        got = C.top_cosines(v, v.withColumnRenamed("id", "other"), ("id", "other"), 2).collect()
    finally:
        C.dots = real
    assert {(r.id, r.other) for r in got} == {(i, j) for i in range(300) for j in (i - i % 2, i - i % 2 + 1)}
    assert sum(seen) < 300 * 10 < 150 * 150


def test_edges(spark, data):
    weights, _ = data
    none = weights.where("false")
    assert C.top_cosines(none, weights.withColumnRenamed("id", "o"), ("id", "o"), 3).isEmpty()
    assert C.similar_pairs(weights, none.withColumnRenamed("id", "o"), ("id", "o"), 0.5).isEmpty()
    odd = spark.createDataFrame([(None, "a", 1.0, 1), (1, None, 1.0, 1), (1, "a", None, 1), (1, "a", 0.6, 1), (1, "a", 0.4, 1)], "id long, term string, weight double, place int")
    assert [tuple(r) for r in C.top_cosines(odd, odd.withColumnRenamed("id", "o"), ("id", "o"), 3).collect()] == [(1, 1, 1.0, 1)]
    with pytest.raises(ValueError):
        C.similar_pairs(odd, odd, ("id", "id"), 0.0)
