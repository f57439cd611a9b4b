"""Nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_folder, stored

#: Rows of a packed matrix, queries that meet a part of the rows in one task, and results that a task keeps before it gives them on.
ROWS_AT_ONCE, QUERIES_AT_ONCE, MOST_KEPT = 1000, 50_000, 2_000_000


def packed(df: DataFrame, id_column: str, vector: str, most: int) -> DataFrame:
    """(ids, matrix, width): vectors scaled to length 1, up to ``most`` of one width in a row; null ids and vectors are left out, those of length 0 are NaN."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND id IS NOT NULL AND NOT exists(v, x -> x IS NULL)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                for at in range(0, part.num_rows, most):
                    one = part.slice(at, most)
                    v = one.column(1).flatten().to_numpy().reshape(one.num_rows, width)
                    v = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, np.nan)
                    yield pa.RecordBatch.from_arrays([pa.array([one.column(0).to_numpy().tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([width], pa.int32())], names=["ids", "matrix", "width"])

    import pyarrow.compute  # noqa: F401  named as pa.compute in the tasks

    return rows.mapInArrow(run, "ids binary, matrix binary, width int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", block_rows: int = 2000, digits: int = 6) -> DataFrame:
    """(query_id, id, cosine, place): the ``k`` rows most like each query by cosine, the query's own id left out.

    Rows and queries are packed into matrices; every matrix of rows meets every block of ``block_rows`` queries of the same width in
    one job. Rows are dealt to parts and blocks to lanes of some ``QUERIES_AT_ONCE`` queries; part and lane meet by a shuffle, as
    blocks repeated for each part would outgrow a broadcast, and a task keeps the best ``k`` of each query as it goes: nothing comes
    to the driver, and what is shuffled is k rows per query and part, never a pair table. Ties go to the smallest id; null vectors,
    those with a null and those of length 0 are like nothing.
    """
    folder = new_folder(vectors.sparkSession, "nearest")
    rows = packed(vectors, id_column, vector, ROWS_AT_ONCE)
    blocks = stored(packed(queries, id_column, vector, block_rows), f"{folder}/queries").withColumn("block", F.monotonically_increasing_id())
    # all widths are the same as a rule: about as many pairs of a part and a lane as partitions, and more lanes with more queries
    asked_for = blocks.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 8
    lanes = -(-asked_for // QUERIES_AT_ONCE) or 1
    parts = -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // lanes)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")).withColumn("lane", upto(lanes))
    every = blocks.select("block", F.col("ids").alias("asked"), F.col("matrix").alias("block_matrix"), "width", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), upto(parts).alias("part"))
    pairs = dealt.hint("merge").join(every.hint("merge"), ["part", "lane", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}

        def given() -> pa.RecordBatch:
            parts = [[np.broadcast_to(asked, score.shape)[f := np.isfinite(score)], ids[f], score[f]] for asked, ids, score in best.values()]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["query_id", "id", "cosine"])

        for batch in batches:
            for r in batch.select(["ids", "matrix", "width", "block", "asked", "block_matrix"]).to_pylist():
                own, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["asked"], np.int64)
                cosine = np.round(np.frombuffer(r["matrix"]).reshape(len(own), r["width"]) @ np.frombuffer(r["block_matrix"]).reshape(len(asked), r["width"]).T, digits)
                cosine[np.isnan(cosine) | (own[:, None] == asked)] = -np.inf
                ids = np.broadcast_to(own[:, None], cosine.shape)
                if r["block"] in best:
                    cosine, ids = np.concatenate([best[r["block"]][2], cosine]), np.concatenate([best[r["block"]][1], ids])
                order = np.lexsort((ids, -cosine), axis=0)[:k]
                best[r["block"]] = (asked, np.take_along_axis(ids, order, 0), np.take_along_axis(cosine, order, 0))
            if sum(b[2].size for b in best.values()) > MOST_KEPT:
                yield given()
        if best:
            yield given()

    found = pairs.mapInArrow(run, "query_id long, id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= k)
