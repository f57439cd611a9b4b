"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a new local one, under a local master alone."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="loomwork-")


def delete(spark: SparkSession, path: str) -> None:
    """A path of any file system that Spark knows, with all below it; nothing if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str, root: str | None = None) -> str:
    return f"{(root or shared_root(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, root: str | None = None) -> Iterator[str]:
    """A new folder in ``root`` (by default the shared one) that is deleted at the block's end."""
    path = new_folder(spark, "scratch", root)
    try:
        yield path
    finally:
        delete(spark, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to a path of its own and read again: computed once, and whole if an executor is lost."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored` in the shared folder, where it stays until the cluster clears it."""
    return stored(df, new_folder(df.sparkSession, name))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most_rows`` rows, else as it is; ``df`` should be stored before."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def free_name(name: str, *taken: str) -> str:
    """``name``, with underscores before it until none in ``taken`` is the same (case aside)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
