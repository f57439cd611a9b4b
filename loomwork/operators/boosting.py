"""Histogram gradient boosting of regression trees that keeps nulls: each split learns the side on which its feature's nulls go.

Features are cut into bins once and stored. A level of a tree is one aggregation: tasks add up the gradients of their rows by (node,
feature, bin), Spark adds up the tasks' sums, and the best split of each node is read off running sums, tried with the nulls on the
left and on the right. What comes to the driver is bounded by nodes, features and bins, never by rows. Rows carry no state: a
row's node and prediction follow from the trees so far; predictions are stored anew every :data:`STORE_EVERY` trees. A table of at
most :data:`ONE_TASK` rows is boosted by the same functions in one task.

Two profiles: ``depth`` alone grows level by level; with ``leaves`` the leaf of largest gain is split next until there are so many.
A node's gain does not depend on the other nodes, so candidates are found level by level and picked in that order afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch_folder

#: Bins of a feature beside that of nulls; rows that one task boosts alone; trees after which predictions are stored.
BINS, ONE_TASK, STORE_EVERY = 255, 50_000, 10
NODES = "tree int, node int, feature string, threshold double, null_left boolean, value double, gain double, rows long"


@dataclass(frozen=True)
class Profile:
    """Settings: trees, their depth, the rate, leaves (None: as many as the depth allows), rows of a leaf, and the weight of squared leaf values."""

    trees: int = 100
    depth: int = 4
    rate: float = 0.1
    leaves: int | None = None
    least_rows: int = 1
    squares: float = 1.0


@dataclass
class Node:
    """A leaf if ``feature`` is negative; children of node i are 2i and 2i + 1, the root is 1."""

    feature: int = -1
    bin: int = 0
    null_left: bool = False
    value: float = 0.0
    gain: float = 0.0
    rows: int = 0


Tree = dict[int, Node]


@dataclass
class Booster:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def predicted(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the trees from ``first`` on for rows of bins."""
        out = np.full(len(bins), self.base if first == 0 else 0.0)
        for tree in self.trees[first:]:
            out += np.array([tree[n].value if n in tree else 0.0 for n in range(max(tree) + 1)])[placed(bins, tree)]
        return out


# --- bins ---


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of rows: 0 for null (NaN), else one more than the number of edges below the value."""
    out = np.zeros(x.shape, dtype=np.int16)
    for j, e in enumerate(edges):
        there = ~np.isnan(x[:, j])
        out[there, j] = 1 + np.searchsorted(e, x[there, j], side="left")
    return out


def edges_of(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Edges between bins: halfway between neighbours where a feature has no more values than bins, else at quantiles."""
    value = lambda c: F.when(~F.isnan(x := F.col(f"`{c}`").cast("double")), x)
    some = df.select(*(value(c).alias(f"f{i}") for i, c in enumerate(features)))
    counts = some.agg(*(F.approx_count_distinct(f"f{i}", 0.02).alias(f"f{i}") for i in range(len(features)))).first()
    shares = [k / bins for k in range(1, bins)]
    # a set is at most a twentieth larger than the estimate says
    values = some.agg(*(F.array_sort(F.collect_set(f"f{i}")) if counts[i] <= bins else F.percentile_approx(f"f{i}", shares, 10_000) for i in range(len(features)))).first()
    out = []
    for i in range(len(features)):
        v = np.unique(np.array(values[i] or [], dtype=np.float64))
        out.append((v[:-1] + v[1:]) / 2 if counts[i] <= bins else v)
    return out


# --- one tree ---


def placed(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of each row."""
    at = np.ones(len(bins), dtype=np.int64)
    for number in sorted(tree):
        n = tree[number]
        if n.feature >= 0:
            rows = np.flatnonzero(at == number)
            b = bins[rows, n.feature]
            left = np.where(b == 0, n.null_left, b <= n.bin)
            at[rows] = 2 * number + 1 - left
    return at


def histogram(bins: np.ndarray, gradient: np.ndarray, at: np.ndarray, nodes: list[int], width: int) -> np.ndarray:
    """Sums of gradients, and rows, by (node, feature, bin)."""
    place = np.full(max(nodes) + 1, -1)
    place[nodes] = range(len(nodes))
    mine = np.flatnonzero((at <= max(nodes)) & (place[np.minimum(at, max(nodes))] >= 0))
    out = np.zeros((len(nodes), bins.shape[1], width, 2))
    base = place[at[mine]] * width
    for j in range(bins.shape[1]):
        key = base + bins[mine, j]
        out[:, j, :, 0] = np.bincount(key, weights=gradient[mine], minlength=len(nodes) * width).reshape(len(nodes), width)
        out[:, j, :, 1] = np.bincount(key, minlength=len(nodes) * width).reshape(len(nodes), width)
    return out


def best_split(sums: np.ndarray, profile: Profile) -> Node:
    """The node with its best split, or as a leaf, from its (feature, bin) sums.

    Of splits whose gains differ by rounding alone the first feature and bin counts, and nulls go right.
    """
    g, n = sums[0, :, 0].sum(), sums[0, :, 1].sum()
    score = lambda g, n: g * g / np.maximum(n + profile.squares, 1e-300)
    node = Node(value=float(-profile.rate * g / (n + profile.squares)) if n else 0.0, rows=int(n))
    below = sums[:, 1:].cumsum(axis=1)  # without the nulls; beyond the last bin only nulls are left for the right
    if not below.size:
        return node
    left = np.stack([below, below + sums[:, :1]], axis=2)  # feature, bin, nulls on the right or left, sums
    right = np.array([g, n]) - left
    gain = (score(left[..., 0], left[..., 1]) + score(right[..., 0], right[..., 1]) - score(g, n)) / 2
    gain[(left[..., 1] < profile.least_rows) | (right[..., 1] < profile.least_rows)] = -np.inf
    top = gain.max()
    if not top > 1e-12 * max(1.0, abs(score(g, n))):
        return node
    j, b, side = np.unravel_index(np.flatnonzero(gain >= top - 1e-9 * abs(top))[0], gain.shape)
    node.feature, node.bin, node.null_left, node.gain = int(j), int(b) + 1, bool(side), float(top)
    return node


def cut_back(tree: Tree, leaves: int) -> Tree:
    """The tree with no more than ``leaves`` leaves: split from the root, the largest gain next."""
    kept, todo = {1: tree[1]}, [(-tree[1].gain, 1)]
    while todo:
        gain, number = heapq.heappop(todo)
        n = kept[number]
        if n.feature < 0:
            continue
        if len(kept) // 2 + 1 >= leaves:
            kept[number] = Node(value=n.value, rows=n.rows)
            continue
        for child in (2 * number, 2 * number + 1):
            kept[child] = tree[child]
            heapq.heappush(todo, (-tree[child].gain, child))
    return kept


def grow(level, profile: Profile) -> Tree:
    """A tree from ``level(tree so far, open nodes)``, which gives the sums of each open node."""
    tree: Tree = {}
    open_nodes = [1]
    for depth in range(profile.depth + 1):
        found = level(tree, open_nodes)
        for number, sums in zip(open_nodes, found, strict=True):
            tree[number] = best_split(sums, profile)
            if depth == profile.depth:
                tree[number].feature, tree[number].gain = -1, 0.0
        open_nodes = [c for number in open_nodes if tree[number].feature >= 0 for c in (2 * number, 2 * number + 1)]
        if not open_nodes:
            break
    return cut_back(tree, profile.leaves) if profile.leaves else tree


# --- boosting ---


def _matrix(batch: pa.RecordBatch, columns: range | list[int]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(j).to_numpy(zero_copy_only=False), dtype=np.float64) for j in columns], axis=1) if len(columns) else np.zeros((batch.num_rows, 0))


def boost_rows(bins: np.ndarray, y: np.ndarray, booster: Booster, profile: Profile, width: int) -> Booster:
    """All trees over rows that are in memory."""
    so_far = np.full(len(y), booster.base)
    for _ in range(profile.trees):
        gradient = so_far - y
        tree = grow(lambda tree, nodes, g=gradient: histogram(bins, g, placed(bins, tree), nodes, width), profile)
        booster.trees.append(tree)
        so_far += np.array([tree[n].value if n in tree else 0.0 for n in range(max(tree) + 1)])[placed(bins, tree)]
    return booster


def fit(df: DataFrame, target: str, features: list[str], profile: Profile = Profile(), folder: str | None = None, one_task: int = ONE_TASK) -> Booster:
    """A booster for ``target`` on the rows that have it. Null and NaN features are nulls; no row, no trees (prediction null-free 0).

    ``folder`` keeps what is stored on the way (the session's ``spark.checkpoint.dir`` if not given); needed beyond ``one_task`` rows.
    """
    spark = df.sparkSession
    rows = df.where(F.col(f"`{target}`").isNotNull() & ~F.isnan(F.col(f"`{target}`").cast("double"))).select(F.col(f"`{target}`").cast("double").alias("y"), *(F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)))
    about = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
    booster = Booster(list(features), edges_of(rows, [f"f{i}" for i in range(len(features))]), float(about.mean or 0.0))
    if not about.n:
        return booster
    width = 2 + max((len(e) for e in booster.edges), default=0)
    if about.n <= one_task:
        run = _one_task(booster, profile, width)
        found = rows.coalesce(1).mapInArrow(run, NODES).toPandas()
        booster.trees = _trees(found, booster)
        return booster
    return _fit_by_levels(spark, rows, booster, profile, width, folder)


def _one_task(booster: Booster, profile: Profile, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b, range(b.num_columns)) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            x = x[np.lexsort(x.T[::-1])]  # sums do not depend on the order in which rows come
            done = boost_rows(binned(x[:, 1:], booster.edges), x[:, 0], booster, profile, width)
            yield pa.RecordBatch.from_pandas(node_rows(done), preserve_index=False, schema=pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.string()), ("threshold", pa.float64()), ("null_left", pa.bool_()), ("value", pa.float64()), ("gain", pa.float64()), ("rows", pa.int64())]))

    return run


def _fit_by_levels(spark: SparkSession, rows: DataFrame, booster: Booster, profile: Profile, width: int, folder: str | None) -> Booster:
    with scratch_folder(spark, folder) as path:
        edges, base = booster.edges, booster.base

        def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = binned(_matrix(b, range(1, b.num_columns)), edges)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, base)), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "so_far", "bins"])

        rows.mapInArrow(to_bins, "y double, so_far double, bins binary").write.parquet(f"{path}/0")
        state, stored = spark.read.parquet(f"{path}/0"), 0
        k = len(edges)

        def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return b.column(0).to_numpy(), b.column(1).to_numpy().copy(), np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.int16).reshape(-1, k)

        def level(tree: Tree, nodes: list[int]) -> list[np.ndarray]:
            later = Booster(booster.features, edges, 0.0, booster.trees[stored:])

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(nodes), k, width, 2))
                for b in batches:
                    y, so_far, bins = arrays(b)
                    total += histogram(bins, so_far + later.predicted(bins) - y, placed(bins, tree), nodes, width)
                at = np.nonzero(total[..., 1])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in at), pa.array(total[..., 0][at]), pa.array(total[..., 1][at].astype(np.int64))], names=["node", "feature", "bin", "g", "n"])

            added = state.mapInArrow(sums, "node int, feature int, bin int, g double, n long").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()  # nodes x features x bins
            out = np.zeros((len(nodes), k, width, 2))
            out[added.node, added.feature, added.bin, 0], out[added.node, added.feature, added.bin, 1] = added.g, added.n
            return list(out)

        for i in range(profile.trees):
            booster.trees.append(grow(level, profile))
            if (i + 1) % STORE_EVERY == 0 and i + 1 < profile.trees:
                later = Booster(booster.features, edges, 0.0, booster.trees[stored:])

                def on(batches: Iterator[pa.RecordBatch], later=later) -> Iterator[pa.RecordBatch]:
                    for b in batches:
                        y, so_far, bins = arrays(b)
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(so_far + later.predicted(bins)), b.column(2)], names=["y", "so_far", "bins"])

                state.mapInArrow(on, "y double, so_far double, bins binary").write.parquet(f"{path}/{i + 1}")
                state, stored = spark.read.parquet(f"{path}/{i + 1}"), i + 1
    return booster


# --- use ---


def predicted(df: DataFrame, booster: Booster, name: str = "prediction") -> DataFrame:
    """``df`` with the booster's prediction of each row; a column of that name gives way."""

    @F.pandas_udf("double")
    def value(x: pd.DataFrame) -> pd.Series:
        return pd.Series(booster.predicted(binned(x.to_numpy(dtype=np.float64, na_value=np.nan), booster.edges)))

    inputs: Column = F.struct(*(F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(booster.features)))
    return df.withColumn(name, value(inputs) if booster.features else F.lit(booster.base))


def predict_one(booster: Booster, row: dict[str, float | None]) -> float:
    x = np.array([[np.nan if row.get(c) is None else float(row[c]) for c in booster.features]])
    return float(booster.predicted(binned(x, booster.edges))[0])


def importances(booster: Booster) -> list[tuple[str, float, int]]:
    """(feature, mean gain of its splits, number of splits) of the features used, largest gain first; equal ones by name."""
    gains: dict[str, list[float]] = {}
    for tree in booster.trees:
        for n in tree.values():
            if n.feature >= 0:
                gains.setdefault(booster.features[n.feature], []).append(n.gain)
    return sorted(((f, sum(g) / len(g), len(g)) for f, g in gains.items()), key=lambda r: (-r[1], r[0]))


def node_rows(booster: Booster) -> pd.DataFrame:
    """The trees as a table of nodes; a leaf has no feature."""
    rows = []
    for t, tree in enumerate(booster.trees):
        for number, n in sorted(tree.items()):
            inner = n.feature >= 0
            edge = booster.edges[n.feature][n.bin - 1] if inner and n.bin <= len(booster.edges[n.feature]) else None
            rows.append((t, number, booster.features[n.feature] if inner else None, edge, n.null_left if inner else None, n.value, n.gain, n.rows))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "null_left", "value", "gain", "rows"])


def _trees(rows: pd.DataFrame, booster: Booster) -> list[Tree]:
    place = {c: i for i, c in enumerate(booster.features)}
    trees: list[Tree] = [{} for _ in range(int(rows.tree.max()) + 1 if len(rows) else 0)]
    for r in rows.itertuples():
        j = place[r.feature] if isinstance(r.feature, str) else -1
        # without a threshold every value goes left: the nulls are on the other side
        b = 0 if j < 0 else len(booster.edges[j]) + 1 if r.threshold is None or np.isnan(r.threshold) else int(np.searchsorted(booster.edges[j], r.threshold)) + 1
        trees[r.tree][r.node] = Node(j, b, bool(r.null_left) if j >= 0 else False, float(r.value), float(r.gain), int(r.rows))
    return trees


def node_table(spark: SparkSession, booster: Booster) -> DataFrame:
    """The trees' nodes, a number that trees and depth bound."""
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in row) for row in node_rows(booster).astype(object).itertuples(index=False)], NODES)


def save(spark: SparkSession, booster: Booster, path: str) -> None:
    """Nodes, edges and ranked gains as tables."""
    node_table(spark, booster).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    edges = [(i, c, [float(v) for v in e], booster.base) for i, (c, e) in enumerate(zip(booster.features, booster.edges, strict=True))]
    spark.createDataFrame(edges, "place int, feature string, edges array<double>, base double").coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")
    ranked = [(i, f, g, n) for i, (f, g, n) in enumerate(importances(booster), 1)]
    spark.createDataFrame(ranked, "place int, feature string, gain double, splits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/importance")


def load(spark: SparkSession, path: str) -> tuple[Booster, DataFrame]:
    edges = spark.read.parquet(f"{path}/edges").orderBy("place").collect()  # a row for each feature
    booster = Booster([r.feature for r in edges], [np.array(r.edges) for r in edges], edges[0].base if edges else 0.0)
    booster.trees = _trees(spark.read.parquet(f"{path}/nodes").toPandas(), booster)
    return booster, spark.read.parquet(f"{path}/importance")
