"""Centroid clustering by ball trees: integer vectors, exact floors, whole balls assigned by the triangle inequality.

Partitions build metric trees once and store them. A ball knows its radius, the number of its vectors and their integer sum. A
round goes down each tree with the centroids that can still be nearest: where one is left, the whole ball is that centroid's and
its stored sum is added; where a leaf is reached, its vectors are compared exactly. All sums, distances and floors are integers, so
results do not depend on partitions or on the trees' shapes.

Rows whose vector is null, has another length, or a null or non-finite component are left out. A component beyond
:data:`MOST` is an error, as squared distances would not fit a long. Repeated rows and ids each count; a null id is kept, and is
chosen as a start only after all others. Equal distances go to the smaller number. Fewer vectors than centroids make fewer
centroids; an empty table gives an empty result. Columns other than the two named take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Largest component after scaling: 64 squares of twice that still fit a long.
MOST = 1 << 27
#: Up to here products of components are exact in doubles.
EXACT = 1 << 22
#: Vectors of a tree, and of a leaf.
TREE, LEAF = 8192, 64
#: A ball's radius and the distances of its centre are rounded; balls within this relative margin and slack go down to exact leaves.
MARGIN, SLACK = 1e-9, 1e-6


def kept(df: DataFrame, key: str, vector: str, size: int, scale: int = 256) -> DataFrame:
    """(key, v): whole vectors of ``size`` finite components, each floor(scale * x) of x as double."""
    x = F.col(f"`{vector}`").cast("array<double>")
    whole = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    # beyond the bound the value is of no matter, only that it is beyond; floor must not leave the longs
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), scale * c))))
    return df.where(F.coalesce(whole, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("key"), scaled.alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:key``, in that order; equal hashes by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64)


def _tree(ids: list, x: np.ndarray) -> dict:
    """The metric tree of some vectors: nodes in preorder, a node's vectors lying side by side."""
    if np.abs(x).max(initial=0) > MOST:
        raise ValueError(f"a component is beyond {MOST} after scaling")
    order, start, end, right, radius, sums = np.arange(len(x)), [], [], [], [], []
    open_nodes = [(0, len(x), -1)]  # (start, end, parent whose right child this is)
    while open_nodes:
        a, b, parent = open_nodes.pop()
        here = len(start)
        if parent >= 0:
            right[parent] = here
        mine = x[order[a:b]]
        total = mine.sum(axis=0)
        off = mine - total / (b - a)
        far = np.sqrt(np.einsum("ij,ij->i", off, off))
        for column, value in ((start, a), (end, b), (right, -1), (radius, float(far.max()) * (1 + MARGIN)), (sums, total)):
            column.append(value)
        if b - a > LEAF and radius[-1] > 0:
            # the vector farthest from the centre, and the one farthest from that: halves by place on the line between them
            one = mine[far.argmax()]
            gap = (mine - one).astype(np.float64)
            axis = gap[np.einsum("ij,ij->i", gap, gap).argmax()]
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(gap @ axis, middle)]
            open_nodes += [(a + middle, b, here), (a, a + middle, -1)]  # the left half comes next, right after its parent
    return {
        "ids": [ids[i] for i in order], "vectors": np.ascontiguousarray(x[order], dtype="<i4").tobytes(), "starts": start, "ends": end, "rights": right, "radii": radius,
        "sums": np.array(sums, dtype="<i8").tobytes(),
    }


TREES = "ids array<long>, vectors binary, starts array<int>, ends array<int>, rights array<int>, radii array<double>, sums binary"


def trees(vectors: DataFrame, size: int) -> DataFrame:
    """Metric trees of up to :data:`TREE` vectors, built from each partition's rows as they come."""

    columns = T._parse_datatype_string(TREES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, ids, held, n = to_arrow_schema(columns), [], [], 0
        made = lambda: pa.RecordBatch.from_pylist([_tree(ids, np.concatenate(held))], schema=schema)
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                ids += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy().reshape(-1, size))
                n += part.num_rows
                if n >= TREE:
                    yield made()
                    ids, held, n = [], [], 0
        if n:
            yield made()

    common.small_batches(vectors.sparkSession)
    return vectors.select("key", "v").mapInArrow(build, TREES)


def _assign(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(start, end, node, numbers) for the balls and leaves of a tree: a ball's node and its one number, or a leaf's numbers by vector and node -1."""
    start, end, right, radius = tree["starts"], tree["ends"], tree["rights"], tree["radii"]
    size = centroids.shape[1]
    x = np.frombuffer(tree["vectors"], dtype="<i4").reshape(-1, size)
    sums = np.frombuffer(tree["sums"], dtype="<i8").reshape(-1, size)
    c = centroids.astype(np.float64)
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, near = todo.pop()
        a, b = start[node], end[node]
        off = c[near] - sums[node] / (b - a)
        far = np.sqrt(np.einsum("ij,ij->i", off, off))
        near = near[far * (1 - MARGIN) <= far.min() * (1 + MARGIN) + 2 * radius[node] + SLACK]
        if len(near) == 1:
            yield a, b, node, near
        elif right[node] < 0:
            yield a, b, -1, near[_squares(x[a:b], centroids[near]).argmin(axis=1)]
        else:
            todo += [(right[node], near), (node + 1, near)]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
    x = x.astype(np.int64)
    return np.stack([np.einsum("ij,ij->i", x - row, x - row) for row in c], axis=1)


def totals(balls: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of each centroid's vectors: a row for each centroid and task, added up by Spark."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, added = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            for tree in batch.to_pylist():
                x = np.frombuffer(tree["vectors"], dtype="<i4").reshape(-1, size)
                sums = np.frombuffer(tree["sums"], dtype="<i8").reshape(-1, size)
                for a, b, node, numbers in _assign(tree, centroids):
                    if node >= 0:
                        counts[numbers[0]] += b - a
                        added[numbers[0]] += sums[node]
                    else:
                        np.add.at(counts, numbers, 1)
                        np.add.at(added, numbers, x[a:b])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(added[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    rows = balls.mapInArrow(run, "cluster int, n long, sums array<long>")
    added = rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).alias("sums"))
    return {r.cluster: (r.n, r.sums) for r in added.collect()}  # a row for each centroid


def assigned(balls: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.to_pylist():
                x = np.frombuffer(tree["vectors"], dtype="<i4").reshape(-1, centroids.shape[1])
                cluster, distance = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
                for a, b, _, numbers in _assign(tree, centroids):
                    cluster[a:b] = numbers
                    off = x[a:b].astype(np.int64) - centroids[cluster[a:b]]
                    distance[a:b] = np.einsum("ij,ij->i", off, off)
                yield pa.RecordBatch.from_arrays([pa.array(tree["ids"], pa.int64()), pa.array(cluster), pa.array(distance)], names=["key", "cluster", "distance"])

    return balls.mapInArrow(run, "key long, cluster int, distance long")


def cluster(df: DataFrame, key: str, vector: str, k: int, rounds: int, size: int, seed: int = 0, scale: int = 256) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every whole vector, stored in the shared folder.

    A round is one pass over the stored trees that brings a row for each centroid to the driver.
    """
    spark: SparkSession = df.sparkSession
    schema = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    with common.scratch(spark) as result:
        vectors = kept(df, key, vector, size, scale)
        centroids = starts(vectors, k, seed)
        if not len(centroids):
            return spark.createDataFrame([], schema)
        balls = common.stored(trees(vectors, size), "balls")
        for _ in range(rounds):
            for i, (n, sums) in totals(balls, centroids).items():
                centroids[i] = [s // n for s in sums]
        found = result(assigned(balls, centroids), "clusters")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, d, sum(inertia.values()), digest[i]) for i, d in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(about), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
