"""Operator 5, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct hashed n-grams of four and five characters (lower-cased, over word borders). From
labelled texts come each feature's log-count ratio between toxic and other texts; the ``n_features`` features whose
ratios stand out most are kept, and a logistic regression is fitted on them with each feature's value being its ratio.

The classifier is fitted on a bounded sample of labelled rows (about ``sample_rows`` of each class, by a hash of the id; a
document's label is the largest that its rows give, and repeated rows of a document count each). Null texts have no features
and get the score of an empty text. Texts of any length are scored whole. Where one class is missing, every score is the share
of toxic rows among the labels (0 without labels). An empty table gives no rows. A column that has the name of the added one
gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 19
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of all hashed features; 0 for those that were not kept
    intercept: float

    def score(self, text: str | None) -> float:
        h = hashed(text or "")
        x = self.intercept
        if len(h):
            h = h[self.weights[h] != 0]
            x += float(self.weights[np.unique(h)].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def hashed(text: str) -> np.ndarray:
    """The hashed n-grams of a text, repeats included."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 4:
        return np.zeros(0, np.uint32)
    two = c[:-1] * MIX[0] + c[1:] * MIX[1]
    two ^= two >> np.uint32(15)
    four = two[:-2] * MIX[2] + two[2:] * MIX[0]
    five = four[:-1] * MIX[1] + c[4:] * MIX[2]
    h = np.concatenate([four ^ (four >> np.uint32(15)), (five ^ (five >> np.uint32(13))) + MIX[0]]) * MIX[1]
    return h >> np.uint32(32 - BITS)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 4000, n_features: int = 4096, tasks: int = 6) -> Model:
    """The classifier, from ``labels``' rows of the documents in ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    by_class = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(by_class) < 2:
        return _constant(by_class.get(0, 0), by_class.get(1, 0))
    wanted = F.lit(False)
    for y, n in by_class.items():
        wanted = wanted | ((F.col("y") == y) & common.rows_by_hash("id", 1.2 * sample_rows / n, "toxicity"))
    with common.scratch(docs.sparkSession) as result:
        chosen = common.small(common.stored(known.where(wanted), "toxic-ids"), 8 * sample_rows)  # about 2.4 * sample_rows ids
        rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(chosen, "id").select("text", "y").repartition(tasks)
        return _fit_sample(result(rows, "toxic-sample"), n_features)


def _constant(zeros: int, ones: int) -> Model:
    share = min(max(ones / max(zeros + ones, 1), 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))


def _fit_sample(sample: DataFrame, n_features: int) -> Model:
    """The classifier from a stored sample (text, y)."""
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return _constant(sizes.get(0, 0), sizes.get(1, 0))

    def make_counts():
        def count(columns):
            total = np.zeros((2, 1 << BITS), np.int64)
            for t, y in zip(*columns, strict=True):
                total[y, np.unique(hashed(t))] += 1
            found = np.flatnonzero(total.sum(0))
            yield [found.tolist(), total[0, found].tolist(), total[1, found].tolist()]

        return count

    counted = common.map_batches(sample, make_counts, [("f", "int"), ("n0", "long"), ("n1", "long")]).groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p, q = (F.col("n1") + 1) / F.lit(sizes[1] + 2.0), (F.col("n0") + 1) / F.lit(sizes[0] + 2.0)
    rated = counted.where("n0 + n1 >= 3").select("f", F.log(p / q).alias("ratio"), ((p - q) / F.sqrt(p * (1 - p) / sizes[1] + q * (1 - q) / sizes[0])).alias("z"))
    top = rated.orderBy(F.desc(F.abs("z")), "f").limit(n_features).collect()
    if not top:
        return _constant(sizes[0], sizes[1])
    features, ratio = np.array([r.f for r in top]), np.array([r.ratio for r in top])
    place = np.full(1 << BITS, -1, np.int32)
    place[features] = np.arange(len(top))

    def make_places():
        def places(columns):
            found = [place[np.unique(hashed(t))] for t in columns[0]]
            yield [[np.sort(i[i >= 0]).tolist() for i in found], columns[1]]

        return places

    weight = F.when(F.col("y") == 1, F.lit((sizes[0] + sizes[1]) / 2 / sizes[1])).otherwise((sizes[0] + sizes[1]) / 2 / sizes[0])
    with common.scratch(sample.sparkSession):
        stored = common.stored(common.map_batches(sample.select("text", "y"), make_places, [("places", "array<int>"), ("y", "int")]), "toxic-places")  # once for all passes of the fit
        vector = F.udf(lambda i: SparseVector(len(ratio), i, ratio[i]), VectorUDT())  # over the bounded sample alone
        train = stored.select(vector("places").alias("features"), F.col("y").cast("double").alias("label"), weight.alias("weight"))
        lr = LogisticRegression(maxIter=60, regParam=0.001, standardization=False, weightCol="weight").fit(train)
    weights = np.zeros(1 << BITS, np.float32)
    weights[features] = lr.coefficients.toArray() * ratio
    return Model(weights, lr.intercept)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with each text's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = shared.value.score
        return lambda texts: [list(map(of, texts))]

    return common.map_texts(docs, text, make, [(column, "double")], keep=keep)


def without_toxic(docs: DataFrame, model: Model, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with their columns."""
    column = common.free_name("toxic_score", *docs.columns)
    return score(docs, model, text, keep=docs.columns, column=column).where(F.col(column) < least).select(*(F.col(f"`{c}`") for c in docs.columns))
