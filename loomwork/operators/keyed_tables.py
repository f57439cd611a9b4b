"""Copy-on-write tables of keyed rows: hash buckets, a manifest of files with key ranges, one atomic swap for each change.

A table is a folder with ``data`` and ``manifest``. A manifest names the table's keys and schema and, for each bucket that has rows, its
folder, number of rows, and smallest and largest key. A merge reads and rewrites the buckets that its keys fall into, each in one task,
and puts the next manifest in place under a number that must not be there yet: readers see the state before or after, two writers
cannot both win, and what a crash leaves behind belongs to no manifest. Manifests are as large as the number of buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import delete, free_name, scratch_folder, stored
from .tables import last_wins, upsert

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: T.StructType
    #: By bucket: its folder, rows, and smallest and largest key as JSON texts.
    files: dict[int, dict]
    #: By writer: the number of its last batch that is in the table.
    applied: dict[str, int]

    def text(self) -> str:
        return json.dumps({"version": self.version, "keys": self.keys, "buckets": self.buckets, "schema": json.loads(self.schema.json()), "files": {str(b): f for b, f in sorted(self.files.items())}, "applied": self.applied})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["keys"], d["buckets"], T.StructType.fromJson(d["schema"]), {int(b): f for b, f in d["files"].items()}, d["applied"])


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- manifests ---

    def _files(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        _, where, fs = self._files()
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest state, or an older one that has not been vacuumed."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            raise LookupError(f"no table in {self.path}")
        jvm, where, fs = self._files()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(where, f"{version:020d}.json"))
        try:
            return Manifest.of(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, manifest: Manifest) -> None:
        """Put a manifest in place; a rename that fails where there is one already is the table's only commit."""
        jvm, where, fs = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        new = path(where, f".{uuid.uuid4().hex}")
        out = fs.create(new, False)
        try:
            out.write(bytearray(manifest.text().encode()))
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(path(where, f"{manifest.version:020d}.json")), options)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {manifest.version} of {self.path} is there already") from e
            raise

    def create(self, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """An empty table; an error if there is one."""
        self._swap(Manifest(0, list(keys), buckets, T.StructType([T.StructField(f.name, f.dataType) for f in schema]), {}, {}))
        return self

    # --- rows ---

    def _read(self, m: Manifest, buckets: list[int]) -> DataFrame:
        folders = [m.files[b]["folder"] for b in buckets if b in m.files]
        return self.spark.read.schema(m.schema).parquet(*folders) if folders else self.spark.createDataFrame([], m.schema)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m, sorted(m.files))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys are among ``wanted``'s, from the buckets that these fall into and whose key range they meet."""
        m = self.manifest()
        at = free_name("bucket", *m.keys)
        asked = wanted.select(*(F.col(k).cast(m.schema[k].dataType).alias(k) for k in m.keys)).distinct()
        least = F.struct(*m.keys)
        span = asked.groupBy(self._bucket(m).alias(at)).agg(F.min(least).alias("lo"), F.max(least).alias("hi"))  # a row for each bucket
        known = self.spark.createDataFrame([(b, f["least"], f["largest"]) for b, f in m.files.items()], f"{at} int, least string, largest string")
        kind = T.StructType([m.schema[k] for k in m.keys])
        meets = (F.col("lo") <= F.from_json("largest", kind)) & (F.col("hi") >= F.from_json("least", kind))
        buckets = sorted(r[0] for r in span.join(known, at).where(meets).select(at).collect())
        same = [F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}")) for k in m.keys]
        return self._read(m, buckets).alias("t").join(asked.alias("w"), same, "left_semi")

    @staticmethod
    def _bucket(m: Manifest):
        return F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("int")

    def merge(self, batch: DataFrame, sequence: str | None = None, keep_old_when_null: tuple[str, ...] = (), writer: str = "", number: int | None = None, before_swap: Callable[[], None] | None = None) -> dict[str, int]:
        """Upsert a batch: what was inserted, updated and kept in the buckets rewritten, and their number.

        Of rows with the same keys the one last by ``sequence`` counts (without it keys must be unique). With ``number`` a batch that the
        ``writer`` has already merged, or an older one, changes nothing. Null keys are keys. Columns that the table has not are
        dropped, missing ones are null. ``before_swap`` is called when all data are written and the manifest is not.
        """
        m = self.manifest()
        if number is not None and m.applied.get(writer, -1) >= number:
            return {"inserted": 0, "updated": 0, "kept": 0, "buckets": 0}
        names = [f.name for f in m.schema]
        at = free_name("bucket", *names)
        batch = batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in m.schema), *([] if sequence is None or sequence in names else [sequence]))
        with scratch_folder(self.spark) as scratch:
            last = (last_wins(batch, m.keys, sequence) if sequence else batch).select(*names)
            updates = stored(last.withColumn(at, self._bucket(m)), f"{scratch}/updates")
            touched = sorted(r[0] for r in updates.select(at).distinct().collect())  # bucket numbers
            if not touched:
                if number is not None:
                    self._swap(Manifest(m.version + 1, m.keys, m.buckets, m.schema, m.files, m.applied | {writer: number}))
                return {"inserted": 0, "updated": 0, "kept": 0, "buckets": 0}
            old = self._read(m, touched)
            merged = upsert(old, updates.drop(at), m.keys, keep_old_when_null).withColumn(at, self._bucket(m))
            folder = f"{self.path}/data/{m.version + 1:020d}-{uuid.uuid4().hex}"
            # a bucket is a task's work, and its rows lie in the order of the keys
            merged.repartition(len(touched), at).sortWithinPartitions(at, *m.keys).write.partitionBy(at).parquet(folder)
        written = self.spark.read.schema(T.StructType([*m.schema, T.StructField("_change", T.StringType()), T.StructField(at, T.IntegerType())])).parquet(folder)
        key = F.struct(*m.keys)
        change = lambda c: F.count_if(F.col("_change") == c).alias(c)
        about = written.groupBy(at).agg(F.count("*").alias("rows"), F.to_json(F.min(key)).alias("least"), F.to_json(F.max(key)).alias("largest"), *map(change, ("inserted", "updated", "kept"))).collect()  # a row for each bucket
        if before_swap:
            before_swap()
        files = m.files | {r[at]: {"folder": f"{folder}/{at}={r[at]}", "rows": r.rows, "least": r.least, "largest": r.largest} for r in about}
        self._swap(Manifest(m.version + 1, m.keys, m.buckets, m.schema, files, m.applied | ({writer: number} if number is not None else {})))
        return {c: sum(r[c] for r in about) for c in ("inserted", "updated", "kept")} | {"buckets": len(about)}

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the ``keep`` newest states and data that no state names; the number of data folders deleted. No merge may run meanwhile."""
        versions = self.versions()
        jvm, where, fs = self._files()
        for v in versions[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(where, f"{v:020d}.json"), False)
        named = {f["folder"].rsplit("/", 1)[0].rsplit("/", 1)[1] for v in versions[-keep:] for f in self.manifest(v).files.values()}
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        gone = [s.getPath().toString() for s in fs.listStatus(data) if s.getPath().getName() not in named] if fs.exists(data) else []
        for folder in gone:
            delete(self.spark, folder)
        return len(gone)
