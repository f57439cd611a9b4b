"""Structured Streaming forms of the batch jobs: feedback counts, idempotent upserts, last good observations, event windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed_tables import BUCKETS, KeyedTable

SIGNALS = "id STRING, timestamp STRING, ticker STRING, source_type STRING, diff_count INT, field_diffs ARRAY<STRUCT<field STRING, before STRING, after STRING>>"


def signal_edits(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Edits (field, before, after) of a growing log of JSON lines."""
    log = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", files_at_once).json(path)
    return log.select("id", F.explode("field_diffs").alias("d")).select("id", "d.*")


def edit_counts(edits: DataFrame) -> DataFrame:
    return edits.where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("field").agg(F.count("*").alias("n_edits"))


def run_available(df: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Everything that has landed, as Parquet below ``folder``, then stop.

    In complete mode each batch replaces the result; in the others ``folder/{batch}`` is its part. A batch that is replayed
    writes the same again.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/batch={number}")

    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_stream(updates: DataFrame, keys: list[str], sequence: str, folder: str, checkpoint: str, keep_old_when_null: tuple[str, ...] = (), buckets: int = BUCKETS) -> KeyedTable:
    """Each batch merged into the keyed table ``folder``, of which it rewrites the buckets that it touches; a replayed batch changes nothing.

    Of older states the one before the last stays, for readers that are at it.
    """
    table = KeyedTable(updates.sparkSession, folder)
    if not table.versions():
        table.create(updates.schema, keys, buckets)

    def apply(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, folder).merge(batch, sequence, keep_old_when_null, writer=checkpoint, number=number)
        KeyedTable(batch.sparkSession, folder).vacuum(keep=2)

    updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table


def last_good(observations: DataFrame) -> DataFrame:
    """(key, at, value, fresh): failed observations (ok false) give the last good value of their key, held as state."""
    import pandas as pd

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for r in pdf.sort_values("at").itertuples():
                value = r.value if r.ok else value
                out.append((key[0], r.at, value, bool(r.ok)))
            yield pd.DataFrame(out, columns=["key", "at", "value", "fresh"])
        state.update((value,))

    return observations.groupBy("key").applyInPandasWithState(step, "key STRING, at TIMESTAMP, value DOUBLE, fresh BOOLEAN", "value DOUBLE", "append", "NoTimeout")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window; rows later than ``late`` are dropped, replays of an event id counted once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
