"""Operator 9, document fingerprints by a randomised edit embedding.

A walk that all texts share reads a text: at each step it writes the character under it down and goes on to the next one,
or stays, by a random bit of step and character. Texts that differ in few edits soon walk in step again, so their edit
distance becomes a Hamming distance between what is written down. The fingerprint samples the written sequence: in each
of ``BINS`` residue classes of steps, the step whose (step, character) hash is smallest gives four bits. Two fingerprints
agree in a bin when the sampled step of both is the same with the same character.

Bands of sampled bins propose near copies, which are verified by their fingerprints' likeness (:func:`near_copies`).

Null texts count as empty. Empty texts have a fingerprint of zeros, like (1) each other and unlike (0) all others. Repeated
ids are rows of their own, in order of their texts' hashes, and null ids come first. Texts of any length are walked whole. An
empty table gives no rows; columns that are not named do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

BINS, PERIOD, KINDS = 128, 4096, 64
#: Characters of text in a range of ids, about, what a row counts besides, rows sampled for a range, and ranges at most.
RANGE_CHARS, ROW_CHARS, SAMPLES, MOST_RANGES = 24_000_000, 200, 20, 20_000
#: Bands, and sampled bins in each: two prints of likeness 0.8 share a band with a chance of 0.96, unlike ones with one of 43 in 16^7.
BANDS, WIDTH = 43, 7
ABSENT = np.uint32(0xFFFFFFFF)
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def stays() -> list[list[int]]:
    """stays()[kind][step % PERIOD]: steps that the walk spends on a character of this kind from this step on."""
    bits = np.random.RandomState(20240229).randint(0, 2, (KINDS, PERIOD)).astype(bool)
    out = []
    for row in bits:
        wait = np.zeros(2 * PERIOD, np.int64)
        n = 1
        for i in range(2 * PERIOD - 1, -1, -1):
            n = 1 if row[i % PERIOD] else n + 1
            wait[i] = n
        out.append(wait[:PERIOD].tolist())
    return out


def walk(codes: np.ndarray, step: int = 0) -> np.ndarray:
    """The step after each character, for a walk that comes to the first one at ``step``."""
    rows, last = map(stays().__getitem__, (codes & np.uint32(KINDS - 1)).tolist()), PERIOD - 1
    return np.array([step := step + row[step & last] for row in rows], np.int64)


def least(codes: np.ndarray, ends: np.ndarray, step: int = 0) -> np.ndarray:
    """The smallest hash of (step, character) in each class of steps; ABSENT in classes without a step."""
    if not len(codes):
        return np.full(BINS, ABSENT)
    out = np.full(BINS, ABSENT)
    for at in range(0, len(codes), 1 << 16):  # memory stays bounded on long texts
        e = ends[at : at + (1 << 16)]
        y = np.repeat(codes[at : at + len(e)], np.diff(e, prepend=step))
        h = y * MIX[0] + np.arange(step, step + len(y), dtype=np.int64).astype(np.uint32) * MIX[1]
        h ^= h >> np.uint32(15)
        h *= MIX[2]
        h ^= h >> np.uint32(13)
        ahead = step % BINS
        h = np.concatenate([np.full(ahead, ABSENT), h, np.full(-(ahead + len(h)) % BINS, ABSENT)])
        out = np.minimum(out, h.reshape(-1, BINS).min(0))
        step = int(e[-1])
    return out


def printed(minima: np.ndarray) -> str:
    """128 hex digits; bins without a step take up the value of the nearest bin before them that has one, mixed with the way."""
    has = np.flatnonzero(minima != ABSENT)
    if not len(has):
        return "0" * BINS
    of = np.searchsorted(has, np.arange(BINS), "right") - 1
    way = np.where(of >= 0, np.arange(BINS) - has[of], np.arange(BINS) + BINS - has[-1]).astype(np.uint32)
    v = minima[has[of]] + way * MIX[1]
    v = (v ^ (v >> np.uint32(16))) * MIX[0] >> np.uint32(28)
    return (v[::2] << np.uint32(4) | v[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal steps in what two walks wrote down, as their fingerprints show it: 0 to 1."""
    if a == b:
        return 1.0
    if not a.strip("0") or not b.strip("0"):
        return 0.0
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    both = max(0.0, (float((x == y).mean()) - 1 / 16) / (15 / 16))  # of 16 values one is equal by chance
    return 2 * both / (1 + both)


@dataclass
class Walked:
    text: str
    codes: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, text: str | None) -> Walked:
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(text or "", codes, walk(codes))

    def edited(self, other: str) -> tuple[str, str, str]:
        """The text with its last quarter replaced by ``other``'s beginning, and both fingerprints; the common part is walked once."""
        n = len(self.codes) // 4
        keep = len(self.codes) - n
        tail = other[:n]
        codes = np.frombuffer(tail.encode("utf-32-le", "surrogatepass"), np.uint32)
        step = int(self.ends[keep - 1]) if keep else 0
        head = least(self.codes[:keep], self.ends[:keep])
        own = np.minimum(head, least(self.codes[keep:], self.ends[keep:], step))
        return self.text[:keep] + tail, printed(own), printed(np.minimum(head, least(codes, walk(codes, step), step)))


def fingerprint(text: str | None) -> str:
    w = Walked.of(text)
    return printed(least(w.codes, w.ends))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, column: str = "fingerprint") -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with each text's fingerprint."""
    return common.map_texts(docs, text, lambda: lambda texts: [list(map(fingerprint, texts))], [(column, "string")], keep=keep)


def range_of(bounds: np.ndarray):
    """A column function of (key, tie): the number of the range that they lie in; ``bounds`` are sorted 16-byte keys."""

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, sortable(key.to_numpy(), tie.to_numpy()), side="right").astype(np.int32))

    return place


def sortable(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Pairs of longs as 16 bytes that sort as the pairs do."""
    both = np.empty((len(key), 2), ">u8")
    both[:, 0], both[:, 1] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in (key, tie))
    return both.view("S16").ravel()


def bounds_of(placed: DataFrame) -> np.ndarray:
    """The bounds of ranges of rows (key, tie, size) with about ``RANGE_CHARS`` of size each.

    Rows are sampled by their size, ``SAMPLES`` for each range; ``MOST_RANGES * SAMPLES`` pairs of longs come to the driver at most.
    """
    total = placed.agg(F.sum("size").alias("size")).first()["size"] or 0
    n = min(MOST_RANGES, total // RANGE_CHARS + 1)
    if n == 1:
        return np.zeros(0, "S16")
    drawn = F.pmod(F.xxhash64(F.lit("ranges"), "key", "tie"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") * F.lit(SAMPLES * n / total) + drawn)
    sampled = placed.select("key", "tie", times.alias("times")).where("times > 0").toArrow()
    keys, times = sortable(sampled["key"].to_numpy(), sampled["tie"].to_numpy()), sampled["times"].to_numpy()
    order = np.argsort(keys, kind="stable")
    after = np.cumsum(times[order])
    return np.unique(keys[order][np.searchsorted(after, np.arange(1, n) * after[-1] / n)]) if len(keys) else np.zeros(0, "S16")


def with_next(docs: DataFrame, run, schema: T.StructType, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``run`` over the rows (bucket, last, doc_id, text) of ranges of ids in order, each range followed by the next one's first row.

    Ranges hold about ``RANGE_CHARS`` characters; one id with many texts is cut by their hashes. Each range is sorted in its
    task, and nothing but a bounded sample of ids and each range's first id comes to the driver. Rows that have both id and text
    in common go to one range.
    """
    common.small_batches(docs.sparkSession)
    key, tie = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.xxhash64("text")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumns({"key": key, "tie": tie})
    bounds = bounds_of(rows.select("key", "tie", (F.coalesce(F.length("text"), F.lit(0)) + F.lit(ROW_CHARS)).cast("long").alias("size")))
    bucket = range_of(bounds)("key", "tie") if len(bounds) else F.lit(0)
    placed = rows.select(bucket.alias("bucket"), "doc_id", "key", "tie", "text")
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first")).orderBy("bucket").collect()  # a row for each range
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    before = {firsts[i].bucket: (firsts[i - 1].bucket, firsts[i].first) for i in range(len(firsts))}
    ahead = docs.sparkSession.createDataFrame([(b, to, f.key, f.tie) for b, (to, f) in before.items()], "bucket int, to int, first long, first_tie long")
    # one row for each range (MOST_RANGES at most); the first row of a range goes to the range before it too
    marked = placed.join(F.broadcast(ahead), "bucket")
    here, there = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("last")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("last"))
    places = F.when((F.col("key") == F.col("first")) & (F.col("tie") == F.col("first_tie")), F.array(here, there)).otherwise(F.array(here))
    dealt = marked.select(F.explode(places).alias("at"), "doc_id", "key", "tie", "text").select("at.bucket", "at.last", "doc_id", "key", "tie", "text")
    # a range is a partition, so that no task gets two
    dealt = dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "last", "key", "tie", "doc_id")
    return dealt.select("bucket", "last", "doc_id", "text").mapInArrow(run, schema)


QUERY = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its fingerprint, that of its text with the last quarter replaced from the next row's text, and likenesses."""
    schema = T._parse_datatype_string(QUERY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types, held, waiting, bucket = to_arrow_schema(schema), None, None, None
        closed = True  # the range before has had its following row
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for b, last, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    bucket, held, closed = b, None, False
                if closed:  # a repeated first row
                    continue
                now = t or ""
                if held is not None:
                    own, w = held
                    edited, fp, edited_fp = w.edited(now)
                    fp_next = fingerprint(now) if last else None
                    row = [own, len(w.codes), hashlib.sha256(edited.encode()).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), fp_next]
                    if waiting is not None:
                        waiting[6] = likeness(waiting[3], fp)
                        for column, value in zip(out, waiting, strict=True):
                            column.append(value)
                    waiting = row
                    if last:
                        row[6] = likeness(fp, fp_next)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        waiting, closed = None, True
                else:
                    waiting = None
                held = None if last else (i, Walked.of(now))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, types, strict=True)], schema=types)

    return with_next(docs, run, schema, doc_id, text)


def digits(fingerprint: Column) -> list[Column]:
    """The fingerprint's 128 hex digits as 8 longs."""
    return [F.conv(F.substring(fingerprint, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(BINS // 16)]


def equal_digits(a: list[Column], b: list[Column]) -> Column:
    """How many of their 128 digits two fingerprints share."""

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    first, *rest = (differ(x, y) for x, y in zip(a, b, strict=True))
    return F.lit(BINS) - sum(rest, first)


def least_equal(least_likeness: float) -> int:
    """The number of equal digits from which fingerprints have that likeness."""
    shared = ("1" * n + "2" * (BINS - n) for n in range(BINS + 1))
    return next(n for n, x in enumerate(shared) if likeness(x, "1" * BINS) >= least_likeness)


def classes_of(prints: DataFrame, least_likeness: float = 0.8, bands: int = BANDS, width: int = WIDTH, seed: int = 11) -> DataFrame:
    """(fingerprint, class_id, class_size): classes of fingerprints that are alike in a band and then verified.

    A band is the value of ``width`` sampled bins. In a band's group every fingerprint is first held against the group's
    smallest one; then all that are still in different classes are held against each other. So any two that share a band and
    are alike are in one class, and a group of near copies is not paired with itself. ``class_id`` is the smallest doc_id of
    the class and ``class_size`` its number of rows.
    """
    with common.scratch(prints.sparkSession) as result:
        fps = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        fps = common.stored(fps.withColumn("node", F.monotonically_increasing_id()), "prints")
        sampled = np.random.RandomState(seed)
        keys = [F.xxhash64(F.lit(b), *(F.substring("fingerprint", int(i) + 1, 1) for i in sampled.choice(BINS, width, replace=False))) for b in range(bands)]
        banded = fps.where("fingerprint <> repeat('0', 128)").select("node", F.explode(F.array(*keys)).alias("band"))
        heads = common.stored(banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head"), "heads")
        members = common.stored(banded.join(heads, "band"), "bands")
        names = [f"d{i}" for i in range(BINS // 16)]
        worded = common.stored(fps.join(members.select("node").distinct(), "node").select("node", *(c.alias(n) for c, n in zip(digits(F.col("fingerprint")), names, strict=True))), "digits")
        other = worded.select(F.col("node").alias("node_b"), *(F.col(n).alias(f"{n}_b") for n in names))
        alike = equal_digits([F.col(n) for n in names], [F.col(f"{n}_b") for n in names]) >= least_equal(least_likeness)
        held = members.where("node <> head").select("node", F.col("head").alias("node_b")).distinct()
        links = common.stored(held.join(worded, "node").join(other, "node_b").where(alike).select(F.col("node").alias("a"), F.col("node_b").alias("b")), "head-links")
        roots = common.stored_alone(prints.sparkSession, lambda: components(links), "head-roots")
        classed = common.stored(members.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "classed")
        apart = classed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
        rest = common.stored(classed.join(apart, "band").join(worded, "node"), "bands-apart")
        mates = rest.select(*(F.col(c).alias(f"{c}_b") for c in rest.columns))
        pairs = rest.join(mates, (F.col("band") == F.col("band_b")) & (F.col("node") > F.col("node_b")) & (F.col("root") != F.col("root_b")) & alike)
        every = links.union(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")))
        ends = common.stored_alone(prints.sparkSession, lambda: components(every), "ends")
        of = common.stored(fps.join(ends, "node", "left").withColumn("root", F.coalesce("root", "node")), "print-roots")
        classes = of.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
        return result(of.join(classes, "root").select("fingerprint", "class_id", "class_size"), "print-classes")


def with_classes(rows: DataFrame, **options) -> DataFrame:
    """``rows`` (doc_id, fingerprint and more) with the class of each row's fingerprint, and the rows in it."""
    return rows.join(classes_of(rows.select("doc_id", "fingerprint"), **options), "fingerprint").select(*rows.columns, "class_id", "class_size")


def near_copies(prints: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id) for rows (doc_id, fingerprint)."""
    return with_classes(prints, **options).select("doc_id", "class_id")
