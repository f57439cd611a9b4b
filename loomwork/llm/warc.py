"""Operator 2, WARC archives: writing captures, reading archives, and assembling transactions.

Writing: each page becomes a request, a response (or, where an earlier page has the same payload, a revisit) and a
metadata record. Request and metadata name the response in WARC-Concurrent-To. Records go through Spark's own text writer
in gzip files with the record mark CR LF CR LF as line end, so any file system that Spark knows can hold them.

Pages of about a size go to files together, as many as keep a file below ``FILE_BYTES`` (a larger page has its own).

Reading: whole files come as bytes, bounded if they were written here; each task unpacks and parses them as a stream, record by
record, by their Content-Length.

Assembly: request, response and metadata are joined through their concurrent-to identifiers, in either direction and over
one record between them, into one nested row for each capture.

Null payloads are empty ones. Of equal payloads the one with the smallest id is the response, rows that repeat it included;
a null id comes after all others. Null or odd URLs lose their control characters, or the header. Columns that are not named do
not matter. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

END = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes and captures in a file before compression, and digests of repeated payloads up to which their table is broadcast.
FILE_BYTES, FILE_ROWS, BROADCAST_ROWS = 64_000_000, 5000, 50_000
#: Bytes of the smallest class of payloads, by how much the next is larger, and the bytes that records have besides (URL included).
LEAST_CLASS, STEP, HEAD_BYTES = 8192, 8, 4096
#: The digits of base 32 as Java writes them, and as RFC 4648 does.
DIGITS, BASE32 = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits, five at a time, are 4 base32 digits each."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.lower(F.concat(*parts)), DIGITS, BASE32)


def record_id(page: Column, row: Column, kind: str) -> Column:
    """An id of its own for each record: pages may have no id, or one that others have too."""
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(f":{kind}>"))


def page_of(name: str) -> Column:
    """The page's id in a record's id."""
    return F.expr(f"try_cast(regexp_extract({name}, '<urn:capture:(-?[0-9]+):', 1) AS BIGINT)")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """WARC files of ``pages`` under ``path``. Payloads below ``least_bytes`` are always written in full.

    Pages are read once and staged with digests, row numbers and size classes; each class then reads its own rows alone.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page"), F.regexp_replace(F.col(f"`{url}`"), r"[\x00-\x20\x7f]", "").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body"), "digest": base32_sha1(F.col("body").cast("binary")), "row": F.monotonically_increasing_id()})
    # the class of a capture by its bytes: 0 up to LEAST_CLASS, then one for each STEP times more
    held = F.col("bytes") + F.lit(2) * F.coalesce(F.octet_length("url"), F.lit(0))
    of = F.when(held <= LEAST_CLASS, 0).otherwise(F.ceil(F.log(held / F.lit(float(LEAST_CLASS))) / F.lit(math.log(STEP)))).cast("int")
    with common.scratch(pages.sparkSession):
        staged = common.shared_path(pages.sparkSession, "pages")
        rows.withColumn("class", of).write.partitionBy("class").parquet(staged)
        schema = T.StructType([*rows.schema, T.StructField("class", T.IntegerType())])
        _write_staged(pages.sparkSession.read.schema(schema).parquet(staged), path, least_bytes, date)


def _write_staged(rows: DataFrame, path: str, least_bytes: int, date: str) -> None:
    order = F.struct(F.col("page").isNull().alias("none"), "page", "row")
    repeated = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = common.small(common.stored(repeated.select("digest", F.col("first.page").alias("first"), F.col("first.row").alias("first_row")), "repeated"), BROADCAST_ROWS)
    classes = [r["class"] for r in rows.select("class").distinct().orderBy("class").collect()]  # about ten
    rows = rows.join(repeated, "digest", "left").withColumn("revisit", F.col("first_row").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")))

    def header(name: str, value: Column | str) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END)), F.lit(""))

    def record(*head: Column, block: Column) -> Column:
        return F.concat(F.lit(f"WARC/1.1{END}"), *head, header("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)

    own = lambda kind: record_id(F.col("page"), F.col("row"), kind)
    response, uri = own("response"), header("WARC-Target-URI", F.col("url"))
    on = header("WARC-Date", date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}{END}"))
    said = F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit(END))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise("response")
    records = [
        record(header("WARC-Type", "request"), header("WARC-Record-ID", own("request")), header("WARC-Concurrent-To", response), uri, on, header("Content-Type", "application/http; msgtype=request"), block=asked),
        record(
            header("WARC-Type", kind), header("WARC-Record-ID", response), uri, on, header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            header("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT))), header("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("first"), F.col("first_row"), "response"))),
            header("Content-Type", "application/http; msgtype=response"), block=F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("body"))),
        ),
        record(header("WARC-Type", "metadata"), header("WARC-Record-ID", own("metadata")), header("WARC-Concurrent-To", response), uri, on, header("Content-Type", "application/warc-fields"), block=said),
    ]
    mark = END + END
    for c in classes or [0]:
        most = max(1, min(FILE_ROWS, FILE_BYTES // (LEAST_CLASS * STEP**c + HEAD_BYTES)))
        lines = rows.where(F.col("class") == c).select(F.concat_ws(mark, *records).alias("value"))
        lines.write.option("lineSep", mark).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/class-{c}")


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, of one or many gzip members or none, in pieces."""
    if data[:2] != b"\x1f\x8b":
        yield data
    else:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            yield from iter(lambda: f.read(step), b"")


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and block of each WARC record in a stream; what is no record is passed over."""
    held, mark = bytearray(), b"\r\n\r\n"
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (at := held.find(b"WARC/1.")) < 0 or (end := held.find(mark, at)) < 0:
            if not more():
                return
        headers: dict[str, list[str]] = {}
        for line in bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        try:
            n = int(headers.get("content-length", ["0"])[0])
        except ValueError:
            n = 0
        while len(held) < end + 4 + n and more():
            pass
        yield headers, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]


FIELDS = [
    ("record_type", "string"), ("record_id", "string"), ("concurrent_to", "array<string>"), ("refers_to", "string"), ("target_uri", "string"), ("date", "string"),
    ("block_bytes", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("declared_digest", "string"), ("block", "binary"),
]


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row for each record of the WARC files under ``path``.

    ``payload_bytes`` and ``payload_digest`` are of the payload itself; of a revisit they are what its headers declare.
    Without ``blocks`` the blocks stay behind in the tasks.
    """

    def make():
        def run(columns):
            for content in columns[0]:
                rows, held = [], 0
                for h, block in parsed(unpacked(content)):
                    first = lambda name, h=h: h.get(name, [None])[0]
                    declared = (first("warc-payload-digest") or "").rpartition(":")[2].upper() or None
                    payload, digest = len(block), None
                    if (first("content-type") or "").startswith("application/http"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        payload = len(body)
                        if first("warc-type") == "revisit":
                            said = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            payload, digest = int(said[0]) if said and said[0].isdigit() else None, declared
                        elif first("warc-type") == "response":
                            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    rows.append((first("warc-type"), first("warc-record-id"), h.get("warc-concurrent-to", []), first("warc-refers-to"), first("warc-target-uri"), first("warc-date"), len(block), payload, digest, declared, block if blocks else None))
                    held += len(block) if blocks else 0
                    if held > 4_000_000 or len(rows) >= 5000:
                        yield list(zip(*rows, strict=True))
                        rows, held = [], 0
                if rows:
                    yield list(zip(*rows, strict=True))

        return run

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return common.map_batches(files, make, FIELDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit record, with its requests and metadata.

    A request or metadata record belongs to a response that it names, that names it, or that is named by (or names) a record
    that it names. Of several, the one with the smallest record id is nested, and ``n_requests`` and ``n_metadata`` count them.
    """
    main = records.where(F.col("record_type").isin("response", "revisit"))
    other = records.where(F.col("record_type").isin("request", "metadata"))
    said = other.select(F.col("record_id").alias("member"), F.explode("concurrent_to").alias("target"))
    named = main.select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("target"))
    ids = main.select(F.col("record_id").alias("target")).distinct()
    direct = said.join(ids, "target", "left_semi").select("member", "target").union(named.select("member", "target"))
    over = said.join(ids, "target", "left_anti").select("member", F.col("target").alias("between"))
    indirect = over.join(direct.select(F.col("member").alias("between"), "target"), "between").select("member", "target")
    links = direct.union(indirect).distinct()
    nested = [c for c in other.columns if c not in ("record_type", "concurrent_to", "refers_to", "declared_digest", "payload_digest")]
    part = other.select(F.col("record_id").alias("member"), "record_type", F.struct(*nested).alias("part"))
    request, metadata = (F.when(F.col("record_type") == kind, F.col("part")) for kind in ("request", "metadata"))
    parts = links.join(part, "member").groupBy(F.col("target").alias("record_id")).agg(F.min(request).alias("request"), F.min(metadata).alias("metadata"), F.count(request).alias("n_requests"), F.count(metadata).alias("n_metadata"))
    none = F.lit(0).cast("long")
    return main.join(parts, "record_id", "left").withColumns({"n_requests": F.coalesce("n_requests", none), "n_metadata": F.coalesce("n_metadata", none)})
