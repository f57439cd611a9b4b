"""``landed``: a data source for files that crawlers and services leave behind, in batch and as a stream.

    register(spark)
    spark.read.format("landed").option("kind", "jsonl").schema("id string, n long").load("/landing/log")
    spark.readStream.format("landed").option("kind", "csv")...

Kinds: ``jsonl`` (a JSON object a line), ``csv`` (lines with a header, lines that begin with # are comments; no line breaks in values) and
``xml`` (an element named by the option ``row`` a row, by default Obs; its attributes and those of the elements around it are its fields).
Fields are the schema's, by name, case aside. Three more columns say where a row comes from and why it is none: ``_file``, ``_at`` (byte in
the file, or number of the element) and ``_bad``: null, or a reason, all fields then being null. Nothing that stands in a file is dropped silently.

Files of lines are read in ranges of ``split_bytes``. Folders named ``name=value`` are fields as well; comparisons with them leave whole files
unread, and other comparisons of fields are made while lines are read. As a stream, an offset is how far each file has been
read: new files and lines that are added to old ones come once, an unfinished last line when it is finished. XML files count as whole
when they appear. Paths are those of pyarrow (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import datetime as dt
import io
import json
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

SPLIT_BYTES, BATCH_ROWS, TAIL = 64 << 20, 5_000, 1 << 16
KINDS = ("jsonl", "csv", "xml")
ORIGIN = "_file string, _at long, _bad string"
DEFAULT = {"jsonl": "value string", "csv": "value string", "xml": "TIME_PERIOD string, OBS_VALUE string"}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with comparisons made in the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)


@dataclass
class Part(InputPartition):
    file: str
    start: int
    end: int
    #: Whether both ends are at line ends; else a line belongs to the range in which it begins.
    whole: bool

    def __post_init__(self) -> None:
        InputPartition.__init__(self, None)


# --- files ---


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of all files below a folder, by path; hidden ones and those that begin with _ are none."""
    from pyarrow import fs

    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    below = lambda f: f.path[len(root) :] if info.type != fs.FileType.File else ""
    return sorted((f.path, f.size) for f in found if not re.search(r"(^|/)[._]", below(f)))


def folder_fields(path: str) -> dict[str, str]:
    return {k.lower(): unquote(v) for k, v in re.findall(r"([^/=]+)=([^/]*)/", path)}


def lines(store, part: Part) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a range of a file, without line ends."""
    with store.open_input_file(part.file) as f:
        size = f.size()
        at = part.start
        f.seek(max(at - 1, 0) if not part.whole else at)
        held, done = b"", False
        if at > 0 and not part.whole:  # the line that begins before the range is the range's before it
            while b"\n" not in held and (more := f.read(TAIL)):
                held += more
            cut = held.find(b"\n")
            if cut < 0:
                return
            at, held = at + cut, held[cut + 1 :]
        end = min(part.end, size)
        while not done:
            more = f.read(TAIL if not part.whole else max(0, min(TAIL, end - f.tell())))
            done, held = not more, held + more
            *whole, rest = held.split(b"\n")
            for line in whole:
                if at >= end:
                    return
                yield at, line.removesuffix(b"\r")
                at += len(line) + 1
            held = rest
        if held and at < end:
            yield at, held.removesuffix(b"\r")


# --- values ---


def typed(value, kind: T.DataType):
    """A value of text or JSON as a Spark type; an error if it is none."""
    if value is None or value == "" and not isinstance(kind, T.StringType):
        return None
    text = isinstance(value, str)
    if isinstance(kind, T.StringType):
        return value if text else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.BooleanType) and (isinstance(value, bool) or text and value.lower() in ("true", "false")):
        return value if not text else value.lower() == "true"
    if isinstance(kind, T.IntegralType) and not isinstance(value, bool) and (isinstance(value, int) or text and re.fullmatch(r"\s*[+-]?\d+\s*", value)):
        bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
        if -(1 << bits - 1) <= int(value) < 1 << bits - 1:
            return int(value)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) and not isinstance(value, bool) and (isinstance(value, int | float) or text and re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", value)):
        return float(value)
    if isinstance(kind, T.DateType) and text:
        return dt.date.fromisoformat(value[:10] if len(value) == 10 else value)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType) and text:
        at = dt.datetime.fromisoformat(value)
        return at.replace(tzinfo=at.tzinfo or dt.UTC) if isinstance(kind, T.TimestampType) else at.replace(tzinfo=None)
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [typed(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {k: typed(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        lower = {k.lower(): v for k, v in value.items()}
        return {f.name: typed(lower.get(f.name.lower()), f.dataType) for f in kind}
    raise ValueError(value)


class Rows:
    """Reading one part: records by kind, fields by the schema, and what is not wanted left out."""

    def __init__(self, options: dict[str, str], schema: T.StructType, wanted: list[Callable[[dict], bool]] | None = None):
        self.kind, self.path = options.get("kind", "jsonl"), options["path"]
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        self.row_tag, self.schema, self.wanted = options.get("row", "Obs"), schema, wanted or []
        self.fields = [f for f in schema if f.name not in ("_file", "_at", "_bad")]
        self.store, _ = _store(self.path)

    def records(self, part: Part) -> Iterator[tuple[int, dict | None, str | None]]:
        """(place, fields, reason)."""
        if self.kind == "xml":
            yield from self._elements(part)
            return
        names = self._header(part.file) if self.kind == "csv" else None
        for at, raw in lines(self.store, part):
            try:
                line = raw.decode()
            except UnicodeDecodeError:
                yield at, None, "not_utf8"
                continue
            if not line.strip():
                continue
            if names is None:
                try:
                    found = json.loads(line)
                    yield (at, found, None) if isinstance(found, dict) else (at, None, "not_an_object")
                except ValueError:
                    yield at, None, "not_json"
            elif not line.startswith("#") and at != names[0]:
                values = self._cells(line)
                yield (at, dict(zip(names[1], values, strict=True)), None) if len(values) == len(names[1]) else (at, None, "wrong_number_of_values")

    @staticmethod
    def _cells(line: str) -> list[str]:
        import csv

        return next(csv.reader([line]))

    def _header(self, file: str) -> tuple[int, list[str]]:
        """Place and names of the first line that is no comment."""
        for at, raw in lines(self.store, Part(file, 0, 1 << 62, False)):
            line = raw.decode("utf-8-sig", "replace")
            if line.strip() and not line.startswith("#"):
                return at, [c.strip() for c in self._cells(line)]
        return -1, []

    def _elements(self, part: Part) -> Iterator[tuple[int, dict | None, str | None]]:
        around, n = [], 0
        try:
            with self.store.open_input_stream(part.file) as f:
                for event, e in ElementTree.iterparse(io.BufferedReader(f) if not hasattr(f, "readable") else f, events=("start", "end")):
                    if event == "start":
                        around.append({k.rpartition("}")[2]: v for k, v in e.attrib.items()})
                        continue
                    if e.tag.rpartition("}")[2] == self.row_tag:
                        yield n, {k: v for a in around for k, v in a.items()}, None
                        n += 1
                    around.pop()
                    e.clear()
        except ElementTree.ParseError:
            yield n, None, "not_xml"

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(self.schema), []
        made = lambda: pa.RecordBatch.from_pylist(held, schema=schema)
        from_folder = folder_fields(part.file)
        for at, found, bad in self.records(part):
            row = {"_file": part.file, "_at": at, "_bad": bad}
            if found is not None:
                lower = from_folder | {k.lower(): v for k, v in found.items()}
                for f in self.fields:
                    try:
                        row[f.name] = typed(lower.get(f.name.lower()), f.dataType)
                    except (ValueError, TypeError):
                        row["_bad"] = f"bad_{f.name}"
                        break
            if row["_bad"] is not None:
                row = {k: row[k] for k in ("_file", "_at", "_bad")}
            if all(w(row) for w in self.wanted):
                held.append(row)
            if len(held) >= BATCH_ROWS:
                yield made()
                held = []
        if held:
            yield made()


# --- the source ---


COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def as_check(f: Filter, schema: T.StructType) -> tuple[str, Callable[[object], bool]] | None:
    """(field, check of its value) of a comparison that Python makes as Spark does; None of others."""
    name = getattr(f, "attribute", (None,))
    kinds = {x.name: x.dataType for x in schema}
    if len(name) != 1 or not isinstance(kinds.get(name[0]), T.StringType | T.IntegralType | T.DateType | T.BooleanType):
        return None
    if isinstance(f, IsNull):
        return name[0], lambda v: v is None
    if isinstance(f, IsNotNull):
        return name[0], lambda v: v is not None
    if type(f) in COMPARED and f.value is not None:
        by, value = COMPARED[type(f)], f.value.encode() if isinstance(f.value, str) else f.value  # texts compare by bytes
        return name[0], lambda v: v is not None and by(v.encode() if isinstance(v, str) else v, value)
    if isinstance(f, In) and None not in f.value:
        values = set(f.value)
        return name[0], lambda v: v in values
    if isinstance(f, StringStartsWith):
        return name[0], lambda v: v is not None and v.startswith(f.value)
    return None


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> T.StructType | str:
        return f"{DEFAULT.get(self.options.get('kind', 'jsonl'), DEFAULT['jsonl'])}, {ORIGIN}"

    def reader(self, schema: T.StructType) -> LandedReader:
        return LandedReader(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> LandedStream:  # noqa: N802
        return LandedStream(dict(self.options), schema)


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.whole_schema, self.checks = options, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            check = as_check(f, self.whole_schema)
            if check:
                self.checks.append(check)
            else:
                yield f

    def partitions(self) -> list[Part]:
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        types = {f.name: f.dataType for f in self.whole_schema}
        out = []
        for file, size in files_under(self.options["path"]):
            given = folder_fields(file)
            try:
                value = lambda n, given=given: typed(given[n.lower()], types[n])
                if not all(check(value(n)) for n, check in self.checks if n.lower() in given):
                    continue
            except (ValueError, TypeError):
                pass  # rows say that the folder's value is bad
            if self.options.get("kind") == "xml":
                out.append(Part(file, 0, size, True))
            else:
                out += [Part(file, at, min(at + split, size), False) for at in range(0, size, split)]
        return out or [Part("", 0, 0, True)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.file:
            wanted = [lambda row, n=n, check=check: check(row.get(n)) for n, check in self.checks]
            yield from Rows(self.options, self.whole_schema, wanted).read(part)


class LandedStream(DataSourceStreamReader):
    """Offsets: bytes read of each file, up to the end of its last finished line."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.whole_schema = options, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        store, _ = _store(self.options["path"])
        ends = {file: size if self.options.get("kind") == "xml" else self._finished(store, file, size) for file, size in files_under(self.options["path"])}
        return {"files": json.dumps({f: n for f, n in ends.items() if n}, sort_keys=True)}

    @staticmethod
    def _finished(store, file: str, size: int) -> int:
        """The place after the last line end, looked for from the file's end."""
        with store.open_input_file(file) as f:
            end = size
            while end > 0:
                start = max(0, end - TAIL)
                f.seek(start)
                cut = f.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [Part(f, before.get(f, 0), n, True) for f, n in sorted(after.items()) if n > before.get(f, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        yield from Rows(self.options, self.whole_schema).read(part)

    def commit(self, end: dict) -> None:
        pass
