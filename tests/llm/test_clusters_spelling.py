"""Ball-tree clustering and spelling variants against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import clusters, spelling


def lloyd(rows, k, rounds, size, seed):
    """(id, cluster, distance), centroids of whole vectors by plain integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((gap(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for f, (_, v) in zip(found, kept, strict=True) if f == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, (n := nearest(v))[1], n[0]) for i, v in kept], centroids


def vectors(spark, n=900, size=6, scale=1.0):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(7, size)) * 3
    rows = [(int(i), [float(x) * scale for x in middles[i % 7] + rng.normal(size=size) * 0.4]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (size - 1)), (n + 3, [float("nan")] * size), (n + 4, [float("inf"), *[0.0] * (size - 1)]), (n + 5, [None, *[0.0] * (size - 1)])]
    rows += [(2000 + i, rows[0][1]) for i in range(400)] + [rows[5], rows[5], (None, rows[6][1])]
    return rows, spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, distance string")


@pytest.mark.parametrize("scale", [1.0, 40_000.0])  # products exact in doubles, and beyond
def test_clusters_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(clusters, "TREE", 250)
    monkeypatch.setattr(clusters, "LEAF", 16)
    rows, df = vectors(spark, scale=scale)
    want, centroids = lloyd(rows, 12, 3, 6, 2)
    got = clusters.cluster(df.repartition(5), "vec_id", "embedding", k=12, rounds=3, size=6, seed=2).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    by = Counter()
    for _, j, d in want:
        by[j] += d
    for r in got:
        assert r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_whole_balls_are_assigned(spark):
    rows, _ = vectors(spark)
    x = np.array([v for i, v in rows[:900]])
    tree = clusters._tree(list(range(900)), np.floor(x * 256).astype(np.int64))
    centroids = np.floor(np.array([x[i] for i in range(7)]) * 256).astype(np.int64)
    parts = list(clusters._assign(tree, centroids))
    assert sum(b - a for a, b, _, _ in parts) == 900
    assert sum(b - a for a, b, node, _ in parts if node >= 0) > 450  # more than half never meet a centroid


def test_clusters_of_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = clusters.cluster(df, "vec_id", "embedding", k=40, rounds=2, size=2, seed=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0)] * 2  # equal vectors: the smaller number
    none = clusters.cluster(df.where("false"), "vec_id", "embedding", k=40, rounds=2, size=2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.isEmpty()
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", k=1, rounds=1, size=2)


def plain_words(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(words):
    cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    out = {}
    for w, n in words.items():
        near = [v for v in words if v != w and (len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 1 or v in cuts(w) or w in cuts(v))]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, len(near))
    rows = set()
    for w, n in words.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, out[w][0], root, n, out[w][1], words.get(out[w][0])))
    return rows


def spelling_rows():
    rng = np.random.default_rng(11)
    letters = "abcdeéÿß"
    base = ["".join(rng.choice(list(letters), size=n)) for n in (6, 6, 7, 8, 9, 12, 30, 31)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab"]
    rows = []
    for i in range(700):
        w = base[i % len(base)]
        for _ in range(int(rng.integers(0, 3))):
            at, kind = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 3))
            w = w[:at] + (str(rng.choice(list(letters))) if kind else "") + w[at + (kind != 1) :]
        count = 5 if i % 3 else int(rng.integers(1, 300))
        rows.append((int(i), (w.upper() if w.isascii() else w) + " " + " ".join([w] * count)))
    return [*rows, (1, None), (None, "Nullkey " * 6), (3, ""), rows[2], (701, "x" * 70_000), (702, ("ending" + "x" * 3000 + " ") * 5), (703, ("ending" + "x" * 2999 + " ") * 30), (704, "12 3,4 été×÷" * 9)]


@pytest.mark.parametrize("most_words", [3, spelling.MOST_WORDS])
def test_variants_equal_brute_force(spark, most_words):
    rows = spelling_rows()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = plain_variants(plain_words(rows))
    got = [tuple(r) for r in spelling.variants(df, most_words=most_words).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in got) > 20 and any(r[2] != r[1] for r in got if r[1])  # chains longer than one step


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "few words here")], "doc_id long, text string")
    assert spelling.variants(df).isEmpty() and spelling.variants(df.where("false")).isEmpty()


def test_shards_stay_small(spark):
    """Words with one beginning that a third of the vocabulary shares are dealt on until few meet."""
    words = [("common" + a + b + c + d, 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "ab"]
    vocabulary = spark.createDataFrame(words, "word string, n long")
    seen = []
    real = spelling._pairs_of
    spelling._pairs_of = lambda shards: (seen.append(shards.groupBy("shard").count().agg({"count": "max"}).first()[0]), real(shards))[1]
    try:
        n = spelling.near_pairs(vocabulary, most_words=50, shortest=6).count()
    finally:
        spelling._pairs_of = real
    assert n == len(words) * (7 + 7 + 7 + 1) and max(x for x in seen if x) <= 8 + 8 * 8  # eight letters
