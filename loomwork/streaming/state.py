"""Keeping the last good observation of each key as state that outlives restarts, expires, and can be read as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of the state and its fields.
LAST, LAST_TYPE = "last", "value DOUBLE, at TIMESTAMP"
OUTPUT = "key STRING, at TIMESTAMP, value DOUBLE, origin STRING"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the streams that are started inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class KeepLast(StatefulProcessor):
    """Rows (key, at, value, ok, seed) to (key, at, value, origin).

    A good observation is ``fresh`` and kept; one that failed gives the value kept (``kept``), else the seed's (``seed``), else null
    (``none``). A value goes when event time has passed it by ``keep_ms`` without a newer one: a row ``expired`` says so. A good
    observation that comes late does not replace a newer one.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(LAST, LAST_TYPE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.last.get() if self.last.exists() else None
        value, since = (kept[0], pd.Timestamp(kept[1])) if kept else (None, None)
        for frame in rows:
            out = []
            for r in frame.sort_values(["at", "ok"]).itertuples():
                if r.ok:
                    out.append((key[0], r.at, r.value, "fresh"))
                    if since is None or r.at >= since:
                        value, since = r.value, r.at
                elif since is not None and r.at < since + pd.Timedelta(milliseconds=self.keep_ms):
                    out.append((key[0], r.at, value, "kept"))
                else:
                    out.append((key[0], r.at, r.seed, "none" if pd.isna(r.seed) else "seed"))
            yield pd.DataFrame(out, columns=["key", "at", "value", "origin"]).astype({"value": "float64"})
        if since is not None and (kept is None or since != pd.Timestamp(kept[1]) or value != kept[0]):
            self.last.update((None if pd.isna(value) else float(value), since.to_pydatetime()))
            self.handle.registerTimer(_ms(since) + self.keep_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists() and _ms(pd.Timestamp(self.last.get()[1])) + self.keep_ms <= at:  # else a newer value has its own timer
            self.last.clear()
            yield pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(at, unit="ms")], "value": [float("nan")], "origin": ["expired"]})

    def close(self) -> None:
        pass


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def keep_previous(observations: DataFrame, keep: str = "90 days", late: str = "1 day") -> DataFrame:
    """A stream of (key, at, value, ok, seed) as :class:`KeepLast` gives it; rows later than ``late`` are dropped by the watermark.

    Needs the session's time zone to be UTC, as states are read back in it. A null key is a key of its own; null ``ok`` is a failure;
    rows without a time are dropped. Start it inside :func:`rocks`.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = observations.where("at IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("value").cast("double").alias("value"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col("seed").cast("double").alias("seed"))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(statefulProcessor=KeepLast(keep_ms), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")


def run_to_files(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """All that has landed, appended to ``folder`` exactly once, then stop."""
    with rocks(rows.sparkSession):
        rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def kept_values(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, value, at): what the state of a stream's checkpoint keeps for each key, read from its last batch."""
    with rocks(spark):
        state = spark.read.format("statestore").option("stateVarName", LAST).load(checkpoint)
    return state.select(F.col("key.key").alias("key"), F.col("value.value").alias("value"), F.col("value.at").alias("at"))
