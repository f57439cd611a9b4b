"""What the text operators share: words, Arrow batches of texts, bounded samples, and tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space; ``bytes.split()`` of UTF-8 cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\r\x0b\x0c"
ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]")

Batch = list[list]
#: Bytes of an Arrow batch that goes to a Python worker; Spark's own bound is sixteen times as much, for each task and on both sides.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a session with a local master gets one of its own; on a cluster there is none that all executors see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomwork-"))
            made = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = made.get()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; deleted with the :func:`scratch` block in which it is asked for, if there is one."""
    path = f"{shared_folder(spark)}/loomwork-{name}-{uuid.uuid4().hex}"
    if _blocks():
        _blocks()[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, and whole if an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_open = threading.local()


def _blocks() -> list[list[str]]:
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    return _open.blocks


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are stored inside the block are deleted at its end.

    The block gets a function like :func:`stored` whose tables outlive it; they belong to the block around it, if any.
    """
    _blocks().append(own := [])

    def result(df: DataFrame, name: str) -> DataFrame:
        _blocks().pop()
        try:
            return stored(df, name)
        finally:
            _blocks().append(own)

    try:
        yield result
    finally:
        _blocks().pop()
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, stored; tables that it has stored on the way are deleted."""
    with scratch(spark) as result:
        return result(make(), name)


def free_name(name: str, *taken: str) -> str:
    """``name``, with underscores before it until no name in ``taken`` is the same (case aside)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most_rows`` rows, else unchanged for a shuffled join.

    At most ``most_rows + 1`` rows are counted; ``df`` should be stored before.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def rows_by_hash(key: str | Column, share: float, seed: str) -> Column:
    """True for about ``share`` of the keys, the same ones in each run and on any partitioning."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n (a null key: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes where nobody has set a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[], Callable[[Batch], Iterable[Batch]]], fields: list[tuple[str, str]]) -> DataFrame:
    """Arrow batches of ``df``'s columns, as Python lists, through the function that ``make`` returns for each task.

    The function yields lists of columns for ``fields`` (name, Spark type).
    """
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, work = to_arrow_schema(schema), None
        for batch in batches:
            work = work or make()
            for columns in work([c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list[list]]], fields: list[tuple[str, str]], keep: list[str] | None = None, slice_chars: int = 1_000_000) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) with the columns ``fields`` that the function from ``make`` gives for its texts.

    The function gets lists of texts (some may be None) of about ``slice_chars`` bytes together, or a single longer one;
    kept columns pass by without being turned into Python objects. A kept column with the name of an added one gives way.
    If the function has an attribute ``done``, that is called at the task's end, so that a worker that goes on to other stages
    keeps no cache.
    """
    small_batches(df.sparkSession)
    names = {n.lower() for n, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType([*(df.schema[c] for c in keep), *added])
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(free_name("text_to_map", *keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types, work = to_arrow_schema(added), make()
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(len(keep))), 0).to_pylist()
            start, held = 0, 0
            for end, n in enumerate([*lengths, None]):
                if end > start and (n is None or held + n > slice_chars):
                    part = batch.slice(start, end - start)
                    made = work(part.column(len(keep)).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, type=f.type) for c, f in zip(made, types, strict=True))], names=[*keep, *types.names])
                    start, held = end, 0
                held += n or 0
        getattr(work, "done", bool)()

    import pyarrow.compute  # noqa: F401  named as pa.compute in the tasks

    return source.mapInArrow(run, schema)


def sample_by_hash(df: DataFrame, key: str, rows: int, seed: str, total: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), chosen by a hash of ``key``."""
    total = df.count() if total is None else total
    return df.where(rows_by_hash(key, 1.2 * rows / total, seed)) if total > rows else df
