"""One isolation forest over all series: trees grown in parallel from bounded hash samples, scores and threshold over all rows.

Each tree takes the rows with the smallest hashes of (key, period, seed, tree); a share of all rows that holds them is found by number, so
that no more than a few samples' worth of rows is dealt to a tree's task. Grown trees are arrays of bounded size (trees x twice the
sample) that go to every task with the scoring. The cut at the contamination's quantile uses exact places counted in ranges. Memory does
not grow with the rows, and samples, trees and scores are the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .benchmark import placed_values, quantile
from .shared import free_name, new_folder, result, scratch_folder, stored

#: Trees, rows of a sample, contamination, and the fewest rows of a series.
TREES, SAMPLE, CONTAMINATION, LEAST_POINTS, SEED = 100, 256, 0.05, 12, 42
FEATURES = ("v", "lag1", "lag2", "lag3", "mean3", "std3", "change")
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # feature (negative: leaf), cut, left child, depth counted at a leaf; right is left + 1


def series_features(df: DataFrame, key: str, value: str = "value", period: str = "period", least: int = LEAST_POINTS) -> DataFrame:
    """(key, period, features) of rows that have them all: the value, three lags, mean and deviation of three rows, change.

    Series with fewer than ``least`` such rows are left out.
    """
    w = Window.partitionBy("key").orderBy("at")
    rows = df.select(F.col(key).alias("key"), F.col(period).alias("at"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumns({f"lag{k}": F.lag("v", k).over(w) for k in (1, 2, 3)})
    mean = (F.col("v") + F.col("lag1") + F.col("lag2")) / 3
    off = lambda c: (F.col(c) - F.col("mean3")) * (F.col(c) - F.col("mean3"))
    rows = rows.withColumn("mean3", mean).withColumns({"std3": F.sqrt((off("v") + off("lag1") + off("lag2")) / 2), "change": F.try_divide("v", F.col("lag1")) - 1})
    whole = rows.where(F.forall(F.array(*FEATURES), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return whole.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where(F.col("n") >= least).drop("n")


def expected(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, seed: int, tree: int) -> Tree:
    """A tree of random cuts over sampled rows, in their given order."""
    rng, limit = np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(x), 2))))
    feature, cut, left, depth = [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        for column, empty in ((feature, -1), (cut, 0.0), (left, -1), (depth, level + expected(len(rows)))):
            column.append(empty)
        todo.append((len(feature) - 1, rows, level))
        return len(feature) - 1

    todo: list[tuple[int, np.ndarray, int]] = []
    node(np.arange(len(x)), 0)
    while todo:
        at, rows, level = todo.pop(0)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(high > low)
        if level >= limit or not len(wide):
            continue
        feature[at] = int(rng.choice(wide))
        cut[at] = float(rng.uniform(low[feature[at]], high[feature[at]]))
        below = x[rows, feature[at]] < cut[at]
        left[at] = node(rows[below], level + 1) if below.any() else -1
        if left[at] < 0 or below.all():  # the cut fell on the edge: nothing is parted
            feature[at], left[at] = -1, -1
            if below.all():
                todo.pop()
            continue
        node(rows[~below], level + 1)
    return np.array(feature), np.array(cut), np.array(left), np.array(depth)


def depths(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Mean depth of rows over all trees."""
    total = np.zeros(len(x))
    for feature, cut, left, depth in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = left[here] + (x[rows, feature[here]] >= cut[here])
        total += depth[at]
    return total / len(trees)


def samples(rows: DataFrame, total: int, trees: int, size: int, seed: int) -> DataFrame:
    """(tree, place, key, at, features): for each tree the ``size`` rows with the smallest hashes (all, if there are no more)."""
    share = min(1.0, 3 * size / max(total, 1))
    while True:
        bound = F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)
        hashes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("key", "at", F.lit(seed), t).alias("h")))
        some = rows.withColumn("s", F.explode(F.filter(hashes, lambda s: s.h <= bound))).select("s.tree", "s.h", "key", "at", *FEATURES)
        place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "key", "at", *FEATURES))
        found = stored(some.withColumn("place", place).where(F.col("place") <= size), new_folder(rows.sparkSession, "samples"))
        if share == 1 or not found.groupBy("tree").count().where(F.col("count") < size).count() and found.select("tree").distinct().count() == trees:
            return found
        share = min(1.0, 4 * share)  # a tree without enough rows: chance, or hashes that many rows share


def fit(rows: DataFrame, trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> tuple[list[Tree], int]:
    """The trees, and the number of rows each has sampled."""
    total = rows.count()
    if not total:
        return [], 0

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        number = int(pdf["tree"].iloc[0])
        return pd.DataFrame([[number, *(a.tolist() for a in grow(pdf[list(FEATURES)].to_numpy(float), seed, number))]], columns=["tree", "feature", "cut", "left_child", "depth"])

    grown = samples(rows, total, trees, size, seed).groupBy("tree").applyInPandas(one, "tree int, feature array<int>, cut array<double>, left_child array<int>, depth array<double>")
    return [(np.array(r.feature), np.array(r.cut), np.array(r.left_child), np.array(r.depth)) for r in grown.orderBy("tree").collect()], min(size, total)  # trees x twice the sample


def anomalies(df: DataFrame, key: str, value: str = "value", period: str = "period", contamination: float = CONTAMINATION, seed: int = SEED, trees: int = TREES, size: int = SAMPLE, least: int = LEAST_POINTS) -> DataFrame:
    """(key, period, value, score, is_anomaly) over all series by one forest; negative scores are anomalies. Stored in the shared folder.

    A contamination outside (0, 0.5) becomes the default. Rows without all features have no score.
    """
    share = contamination if 0 < contamination < 0.5 else CONTAMINATION
    spark = df.sparkSession
    names = (key, period, value)
    with scratch_folder(spark) as folder:
        rows = stored(series_features(df, key, value, period, least), f"{folder}/rows")
        forest, size = fit(rows, trees, size, seed)
        scale = max(expected(size), 1e-9)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([b.column(b.schema.get_field_index(f)).to_numpy() for f in FEATURES], axis=1)
                raw = np.round(-np.exp2(-depths(x, forest) / scale), 9) if forest else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raw)], names=["key", "at", "v", "raw"])

        kinds = f"key {rows.schema['key'].dataType.simpleString()}, at {rows.schema['at'].dataType.simpleString()}, v double, raw double"
        raw = stored(rows.mapInArrow(score, kinds), f"{folder}/raw")
        one = free_name("one", "raw")
        offset = placed_values(raw.select(F.lit(0).alias(one), "raw"), [one], "raw").withColumnRenamed("raw", "value").groupBy(one).agg(quantile(share).alias("offset")).first()
        cut = F.col("raw") - F.lit(offset.offset if offset else 0.0)
        return result(raw.select(F.col("key").alias(names[0]), F.col("at").alias(names[1]), F.col("v").alias(names[2]), F.round(cut, 6).alias("score"), (cut < 0).alias("is_anomaly")), "anomalies")
