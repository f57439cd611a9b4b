"""Operator 6, mixing sources to target weights, in DataFrame operations alone.

Every document gets a hash-random key. Within each source the documents are sorted by key in ranges of keys (buckets, as
many as the source needs), and distributed prefix sums of their sizes (sums by bucket, then sums before each bucket, then
sums inside it) place the cut at the source's exact budget: whole epochs first, then documents up to the cut, and of the
document at the cut as many words as are left. Only sizes and keys are shuffled; texts are not.

Budgets: sources by code point, null last, have the weights in turn and share ``share`` times all sizes; a target stops
at ``epochs`` times its source's size, and the excess goes to the others by weight until none is above (in closed form:
sources are taken by size for their weight until the rest can bear its share).

A null text has size 0. Rows with the same id have the same key: where the cut falls on them, they share what is left
evenly. An empty table gives no rows. The table of sources, one row each, is in one task; a source's documents are not. Other
columns, whatever their names, do not matter and stay in :func:`mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a source's range of keys that one task sorts.
BUCKET_ROWS = 200_000
#: Sources, or ranges of keys, up to which their table is broadcast.
BROADCAST_ROWS = 20_000


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(common.WORD)), F.lit(0)).cast("long")


def random_key(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """A row for each source: its number, rows, size, target, whole epochs and the words over them."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()  # one row for each source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumn("source_no", F.row_number().over(by_name)).withColumn("w", w).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"), (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"))
    rows = rows.withColumn("capped", F.col("cap") * F.col("left_w") <= F.col("left") * F.col("w"))
    budget = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(budget * F.col("w") / F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)))
    whole = F.floor("target")
    return rows.select("source", "source_no", "n", "source_size", "target", F.coalesce(F.floor(F.try_divide(whole, "source_size")), F.lit(0)).alias("epochs")).withColumn("rest", whole - F.col("epochs") * F.col("source_size"))


def cuts(sizes: DataFrame, of: DataFrame) -> DataFrame:
    """``of`` with the key at each source's cut, the words left for it, and the rows that have this key."""
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.ceil(F.col("n") / F.lit(BUCKET_ROWS)))
    chosen = common.small(of.where("rest > 0").select(F.col("source").alias("s"), "source_no", "n", "rest"), BROADCAST_ROWS)
    keyed = sizes.join(chosen, F.col("source").eqNullSafe(F.col("s"))).select("source_no", bucket.alias("bucket"), "key", "size")
    rows = common.stored(keyed.groupBy("source_no", "bucket", "key").agg(F.sum("size").alias("words"), F.count("*").alias("same")), "mix-keys")
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("words").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    rest = of.select("source_no", "rest")
    at = common.stored(sums.select("source_no", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead")), "mix-buckets").join(common.small(rest, BROADCAST_ROWS), "source_no")
    inside = Window.partitionBy("source_no", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(common.small(at, BROADCAST_ROWS), ["source_no", "bucket"]).withColumn("before", F.col("ahead") + F.sum("words").over(inside) - F.col("words"))
    cut = placed.where("before < rest AND rest <= before + words").select("source_no", F.col("key").alias("cut"), (F.col("rest") - F.col("before")).alias("cut_words"), "same")
    return of.join(cut, "source_no", "left")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, key) of every row, and a row for each source with its target and cut."""
    with common.scratch(docs.sparkSession) as result:
        rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(text).alias("size"), random_key(doc_id, seed).alias("key"))
        sizes = result(rows, "mix-sizes")
        of = common.stored(targets(sizes, weights, share, epochs), "mix-targets")
        return sizes, result(cuts(sizes, of), "mix-cuts")


def words_taken() -> Column:
    """Words that the mix takes of a row with ``size`` and ``key``, beside its source's columns."""
    part = F.when(F.col("cut").isNull() | (F.col("key") > F.col("cut")), F.lit(0)).when(F.col("key") < F.col("cut"), F.col("size")).otherwise(F.least(F.col("size"), F.floor(F.col("cut_words") / F.col("same"))))
    return (F.col("epochs") * F.col("size") + part).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``; options as of :func:`plan`."""
    sizes, of = plan(docs, **options)
    of = common.small(of.withColumnRenamed("source", "s"), BROADCAST_ROWS)
    return sizes.join(of, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), words_taken().alias("taken"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mix itself: ``docs``' rows once for each whole time that they are taken, and the words taken of a cut document."""
    _, of = plan(docs, doc_id=doc_id, text=text, source=source, seed=seed, **options)
    names = ("of", "size", "key", "taken", "copy", "words")
    own = {n: common.free_name(f"mix_{n}", *docs.columns) for n in names}
    of_, size, key, taken, copy, words = (F.col(own[n]) for n in names)
    of = common.small(of.select(F.struct("source", "epochs", "cut", "cut_words", "same").alias(own["of"])), BROADCAST_ROWS)
    rows = docs.withColumns({own["size"]: size_of(text), own["key"]: random_key(doc_id, seed)}).join(of, F.col(f"`{source}`").eqNullSafe(of_["source"]))
    part = F.when(of_["cut"].isNull() | (key > of_["cut"]), F.lit(0)).when(key < of_["cut"], size).otherwise(F.least(size, F.floor(of_["cut_words"] / of_["same"])))
    rows = rows.withColumn(own["taken"], (of_["epochs"] * size + part).cast("long")).where(taken > 0)
    rows = rows.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.ceil(taken / size))))
    rows = rows.withColumn(own["words"], F.least(size, taken - (copy - 1) * size))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0)), F.lit(1), words.cast("int")), "")
    cut = F.when(words < size, first).otherwise(F.col(f"`{text}`"))
    return rows.select(*(cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
