"""Operator 7, SimHash near-copies by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits are found by cutting them into two segments (three would be needed
for one to be equal): one of the two then differs in at most one bit. Each distinct fingerprint gives, for every segment
and every bit of it, the segment without that bit; equal variants are joined and the pairs' whole distance is verified.

A variant that many fingerprints share (a large group of near copies) would give a pair for any two of them. Up to
``MOST_PAIRED`` members are paired; beyond, an exact way needs no pairs: two fingerprints differ in at most
two bits if and only if some 64-bit value differs from both in at most one, so every member gives the 65 values around it
and the members that share a value are linked to the smallest of them. Variants have 31 bits of content, so from some 10^10
distinct fingerprints on most of them are shared by chance and most fingerprints go that way too: still exact, with 65 rows each.

Null texts and texts without words have the fingerprint zero. Equal fingerprints are one node, so copies are never paired.
Repeated rows and ids are rows of their own; a group's id is the smallest doc_id that is not null. An empty table gives no rows;
other columns do not matter.

Near copies by Jaccard similarity (:func:`classes`, :func:`near_copies`, :func:`without_copies`) use wider signatures of the same
kind and then find exactly what those miss.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BITS = 64
#: Members of a variant's group up to which all of its pairs are verified.
MOST_PAIRED = 6
#: Rows of a fingerprint from which its rows are joined apart from the others.
HOT_ROWS = 200
#: Rows of keys or ids up to which their table is broadcast.
BROADCAST_ROWS = 400_000
#: Shingles that several classes share, up to which their table is broadcast: it is held beside the rows that it chooses from.
BROADCAST_SHINGLES = 20_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1]
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is set if it is set in more than half of the text's shingle hashes."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):  # memory stays bounded on long texts
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int, text: str = "text", keep: list[str] | None = None, column: str = "fp") -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with each text's fingerprint as a long."""
    return common.map_texts(docs, text, lambda: lambda texts: [[fingerprint(t, width) for t in texts]], [(column, "long")], keep=keep)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each half of a fingerprint and each bit of it, the half without the bit, marked with the bit's place."""
    halves = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("fp", 32)
    keys = [half.bitwiseAND(F.lit((1 << 32) - 1 - (1 << bit))).bitwiseOR(F.lit((32 * i + bit) << 32)) for i, half in enumerate(halves) for bit in range(32)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")


def around(fps: DataFrame) -> DataFrame:
    """(z, fp): the fingerprint itself and the 64 that differ from it in one bit."""
    flips = [F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(BITS))]
    return fps.select("fp", F.explode(F.transform(F.array(*flips), lambda x: F.col("fp").bitwiseXOR(x))).alias("z"))


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b) linking distinct fingerprints: all of at most ``distance`` bits apart have a path of such links between them."""
    if distance not in (1, 2):
        raise ValueError("distances of 1 and 2 bits are linked exactly here")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    least = [F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("greatest")]
    shared = common.stored(variants(fps).groupBy("key").agg(*least).where("n > 1"), "variants")
    # a pair alone is read off its group: its members are the least and the greatest
    found = shared.where("n = 2").select(F.col("greatest").alias("a"), F.col("least").alias("b")).where(near)
    more = common.small(shared.where("n > 2").select("key", "n"), BROADCAST_ROWS)
    members = common.stored(variants(fps).join(more, "key"), "members")
    few = members.where(F.col("n") <= MOST_PAIRED).select("key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").where("a > b").select("a", "b")
    found = found.union(pairs.where(near))
    many = common.stored(members.where(F.col("n") > MOST_PAIRED).select("fp").distinct(), "many")
    if distance == 1:
        return found.union(around(many).where("z <> fp").join(many.withColumnRenamed("fp", "z"), "z").select(F.col("fp").alias("a"), F.col("z").alias("b")))
    balls = common.stored(around(many), "around")
    centres = balls.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    return found.union(balls.join(centres, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def groups(docs: DataFrame, width: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row of ``docs``."""
    alone = partial(common.stored_alone, docs.sparkSession)
    with common.scratch(docs.sparkSession) as result:
        rows = result(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width, keep=["doc_id"]), "fingerprints")
        fps = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
        pairs = alone(lambda: links(fps.select("fp"), distance), "print-links")
        roots = alone(lambda: components(pairs), "roots")
        least = fps.join(roots, fps.fp == roots.node).groupBy("root").agg(F.min("first").alias("component_id"))
        linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
        of = result(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "of-print")
    # rows of a fingerprint that very many share are not dealt by it
    hot = common.small(of.where(F.col("n") >= HOT_ROWS).drop("n"), BROADCAST_ROWS)
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(of.drop("n"), "fp")
    return rows.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


#: Wide signatures of near copies: fingerprints of 64 bits, bits of a segment, and its least certain bits that get a variant.
WORDS, SEGMENT, UNSURE = 8, 32, 4
#: Members of a signature's group up to which all pairs are candidates; beyond, each is held against the group's head.
MOST_COMPARED = 6
#: Buckets in which the shingles of all texts are counted, so that prefixes take the rarest.
BUCKET_BITS = 18
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def wide_keys(text: str | None, width: int) -> list[int]:
    """Signatures of a text: each segment of its 512-bit fingerprint, whole and without one of its least certain bits."""
    h = shingle_hashes(text, width)
    if not len(h):
        return []
    ones = np.zeros(WORDS * BITS, np.int64)
    for at in range(0, len(h), 255):  # sums of single bytes do not overflow
        part = h[at : at + 255, None] * ODD
        part ^= part >> np.uint64(29)
        ones += np.unpackbits((part * ODD[::-1]).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    bits = (2 * ones > len(h)).reshape(-1, SEGMENT)
    value = np.packbits(bits, axis=1, bitorder="little").view(np.uint32).ravel().astype(np.int64)
    unsure = np.argpartition(np.abs(2 * ones - len(h)).reshape(-1, SEGMENT), UNSURE, axis=1)[:, :UNSURE]
    segment = np.arange(len(value), dtype=np.int64)[:, None]
    without = (segment * 64 + unsure + 1 << 32) | (value[:, None] & ~(np.int64(1) << unsure))
    return np.concatenate([(segment[:, 0] * 64 << 32) | value, without.ravel()]).tolist()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, width))


def similarity(a, b) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def set_bits(shingles: np.ndarray) -> np.ndarray:
    """As many bits as a shingle set has members at least, and 512 at least, each the parity of the shingles that fall on it.

    A shingle that only one of two sets has turns one bit, so as many bits as two of these differ in, the sets differ in
    at least. A longer one folds to the length of a shorter one (:func:`folded`).
    """
    size = 1 << max(9, (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """The 512 bits of a set that its longer bits fold to."""
    return np.bitwise_xor.reduce(bits.reshape(-1, WORDS), axis=0)


def shared_least(n: Column, least: float) -> Column:
    """The fewest shingles that two sets of ``n`` together share if their similarity is ``least``."""
    return F.ceil(F.lit(least / (1 + least)) * n - F.lit(1e-9))


def differing(x: str, y: str) -> Column:
    """In how many bits two arrays from :func:`set_bits` differ, one of which may be twice as long as the other."""

    def to_length(z: str, other: str) -> Column:
        n = F.size(other)
        halves = F.zip_with(F.slice(z, F.lit(1), n), F.slice(z, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(z) > n, halves).otherwise(F.col(z))

    bits = F.zip_with(to_length(x, y), to_length(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def linked(candidates: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of ``candidates`` whose whole shingle sets have a Jaccard similarity of ``least``.

    Sizes and bits of the sets rule out most unlike pairs before whole sets, 64 times as large, meet.
    """

    def of(pairs: DataFrame) -> DataFrame:
        wanted = common.stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "to-verify")
        return texts.join(common.small(wanted, BROADCAST_ROWS), "node", "left_semi")

    def both_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(rows.select(*(F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in rows.columns)), side)
        return pairs

    def sizes(texts):
        sets = [shingle_set(t, width) for t in texts]
        return [[len(s) for s in sets], [set_bits(s).tolist() for s in sets]]

    sketches = common.stored(common.map_texts(of(candidates), "text", lambda: sizes, [("n", "int"), ("bits", "array<long>")], keep=["node"]), "sketches")
    near = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - F.lit(1e-9)
    apart = F.col("n_a") + F.col("n_b") - 2 * shared_least(F.col("n_a") + F.col("n_b"), least)
    open_ = common.stored(both_sides(candidates, sketches).where(near).where(differing("bits_a", "bits_b") <= apart).select("a", "b"), "open")
    sets = common.map_texts(of(open_), "text", lambda: lambda texts: [[shingle_set(t, width).view(np.int64).tolist() for t in texts]], [("s", "array<long>")], keep=["node"])
    both = F.size(F.array_intersect("s_a", "s_b"))
    return both_sides(open_, common.stored(sets, "shingles")).where(both / (F.size("s_a") + F.size("s_b") - both) >= F.lit(least)).select("a", "b")


def by_signature(texts: DataFrame, key_width: int) -> DataFrame:
    """Candidates (a, b): texts that share a signature.

    All pairs of up to ``MOST_COMPARED`` members of a signature's group, and each of more against the group's head. The head
    is the member whose hash with the signature is smallest, so that it differs from group to group.
    """
    keyed = common.map_texts(texts, "text", lambda: lambda texts: [[wide_keys(t, key_width) for t in texts]], [("keys", "array<long>")], keep=["node"])
    members = common.stored(keyed.select("node", F.explode("keys").alias("key")), "keys")
    shared = common.stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("b"), F.max("node").alias("a")).where("n > 1"), "keys-shared")
    # two alone are read off their group: the least and the greatest
    twos = shared.where("n = 2").select("a", "b")
    more = common.stored(members.join(common.small(shared.where("n > 2").select("key", "n"), BROADCAST_ROWS), "key"), "keys-members")
    many = more.where(F.col("n") > MOST_COMPARED)
    heads = many.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node")).alias("least")).select("key", F.col("least.node").alias("head"))
    heads = common.small(common.stored(heads, "heads"), BROADCAST_ROWS)
    few = more.where(F.col("n") <= MOST_COMPARED).select("key", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "key").where("a > b").select("a", "b")
    stars = many.join(heads, "key").where("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
    return twos.union(pairs).union(stars).where("a <> b").distinct()


def bucket_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle of each of 2^BUCKET_BITS buckets: a table of fixed size, summed over all texts."""
    import pyarrow as pa

    def run(batches):
        counts, held, size = np.zeros(1 << BUCKET_BITS, np.int64), [], 0

        def add() -> None:
            counts[:] += np.bincount((np.concatenate([np.zeros(0, np.uint64), *held]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)

        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py(), width))
                size += len(held[-1])
                if size > 500_000:
                    add()
                    held, size = [], 0
        add()
        found = np.flatnonzero(counts)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["bucket", "n"])

    common.small_batches(texts.sparkSession)
    found = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def rarest_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles in an order that all texts share: those of rare buckets first."""
    return shingles[np.lexsort((shingles, counts[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))]


def by_rare_shingles(texts: DataFrame, roots: DataFrame, width: int, least: float) -> DataFrame:
    """Candidates (a, b) between different classes of ``roots``: all pairs whose shingle sets have a similarity of ``least``, and some more.

    Of sets in one order, the first shingle that two alike ones share is among the first n - ceil(least * n) + 1 of the larger
    and among the first n - ceil(2 * least / (1 + least) * n) + 1 of the smaller. Texts are joined by those; the places of the
    shared shingle, the sizes and the parities of the sets (:func:`set_bits`) rule pairs out in the join. Classes that
    signatures have found are not paired with themselves: shingles of one class alone are left out, and a shingle's largest
    class meets the others only. Nothing is capped; a shingle that many classes share costs comparisons of a few longs, in
    tasks that adaptive execution splits.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bucket_counts(texts, width))

    def make():
        counts = shared.value

        def first(texts):
            out: list[list] = [[], [], []]
            for t in texts:
                s = shingle_set(t, width)
                n = len(s)
                prefix = rarest_first(s, counts)[: n - int(np.ceil(least * n - 1e-9)) + 1] if n else s
                for column, value in zip(out, (n, prefix.view(np.int64).tolist(), folded(set_bits(s)).tolist()), strict=True):
                    column.append(value)
            return out

        return first

    prefixes = common.stored(common.map_texts(texts, "text", make, [("n", "int"), ("prefix", "array<long>"), ("bits", "array<long>")], keep=["node"]), "prefixes")
    shared.unpersist()
    classed = common.stored(prefixes.join(common.small(roots, BROADCAST_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node")), "prefixes-classed")
    of_least = F.col("place") < F.col("n") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - F.lit(1e-9)) + 1
    rows = classed.select("node", "root", "n", F.posexplode("prefix").alias("place", "key"))
    apart = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or(of_least).alias("some")).where("lo < hi AND some").select("key")
    apart = common.small(common.stored(apart, "keys-apart"), BROADCAST_SHINGLES)
    # only what the key decides is joined on it; size and class of the few that are left come after
    at = rows.select("key", "node", "place").join(apart, "key", "left_semi")
    rows = common.stored(common.stored(at, "at-shingles").join(classed.select("node", "root", "n"), "node"), "rare-shingles")
    main = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    bits = classed.select("node", *(F.col("bits")[i].alias(f"w{i}") for i in range(WORDS)))
    rows = rows.join(common.small(common.stored(main, "main-classes"), BROADCAST_ROWS), "key").withColumn("in_main", F.col("root") == F.col("main")).drop("main")
    rows = common.stored(rows.join(bits, "node"), "rare-shingles-bits")
    smaller = rows.where(of_least).select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    both = shared_least(F.col("n") + F.col("n_b"), least)
    differ = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(1, WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("w0_b"))))
    on = (F.col("key") == F.col("key_b")) & (F.col("root") != F.col("root_b")) & ((F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("node") > F.col("node_b"))))
    on &= (F.col("n_b") >= F.lit(least) * F.col("n") - F.lit(1e-9)) & (F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= both) & (differ <= F.col("n") + F.col("n_b") - 2 * both)
    pairs = rows.join(smaller.where("NOT in_main_b"), on).union(rows.where("NOT in_main").join(smaller.where("in_main_b"), on))
    return pairs.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, node, other, text) of the rows with a text: ``node`` is the text's 64-bit hash, ``other`` a second one."""
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("node"), F.xxhash64(F.lit("other"), F.col(f"`{text}`")).alias("other"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")


def classes(docs: DataFrame, least: float = 0.8, width: int = 5, key_width: int = 2, doc_id: str = "doc_id", text: str = "text", signatures_alone: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ids, classes): ``id`` and ``node`` of every row with a text, and ``root``, the class, of every node.

    A node is a text, not an id, so that repeated ids with different texts stay apart. Signatures come first: segments of a
    512-bit SimHash of ``key_width``-word shingles, whole or without one of the bits that are least certain (those that edits
    turn first). Texts that share one are candidates, verified by their whole sets of ``width``-word shingles (64-bit hashes).
    What signatures miss is found exactly: :func:`by_rare_shingles` proposes every pair of ``least`` that is still in two
    classes (not with ``signatures_alone``, which shows what signatures find).

    Should two texts have one 64-bit hash (``other`` tells), they take no part.
    """
    with common.scratch(docs.sparkSession) as result:
        rows = keyed(docs, doc_id, text)
        ids = result(rows.select("id", "node", "other"), "ids")
        nodes = common.stored(ids.groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi")), "nodes")
        more = nodes.where("n > 1").select("node", (F.col("lo") == F.col("hi")).alias("sure"))
        single = rows.join(common.small(more.select("node"), BROADCAST_ROWS), "node", "left_anti").select("node", "text")
        copied = rows.join(common.small(more.where("sure").select("node"), BROADCAST_ROWS), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        texts = single.union(common.stored(copied, "copied"))
        alone = partial(common.stored_alone, docs.sparkSession)
        candidates = alone(lambda: by_signature(texts, key_width), "candidates")
        links = alone(lambda: linked(candidates, texts, width, least), "links")
        roots = alone(lambda: components(links), "near-roots")
        if not signatures_alone:
            pairs = alone(lambda: by_rare_shingles(texts, roots, width, least), "rare-pairs")
            found = alone(lambda: linked(pairs, texts, width, least), "rare-links")
            if not found.isEmpty():
                both = found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
                roots = alone(lambda: components(both), "all-roots")
        of = nodes.where("lo = hi").join(common.small(roots, BROADCAST_ROWS), "node", "left")
        return ids.drop("other"), result(of.select("node", F.coalesce("root", "node").alias("root"), "n"), "classes")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class that is not null) and class_size of every row of ``docs``.

    Rows without a text are classes of their own, with their doc_id and 1. Options as of :func:`classes`.
    """
    with common.scratch(docs.sparkSession) as result:
        ids, of = classes(docs, doc_id=doc_id, text=text, **options)
        rows = ids.join(common.small(of.drop("n"), BROADCAST_ROWS), "node")
        sizes = common.stored(rows.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "class-sizes")
        found = rows.join(common.small(sizes, BROADCAST_ROWS), "root").select(F.col("id").alias("doc_id"), "class_id", "class_size")
        none = docs.where(F.col(f"`{text}`").isNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{doc_id}`").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
        return result(found.union(none), "near-copies")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near copies: the smallest id, null ids last; of that id, one text and one row.

    Rows without a text stay, each. Options as of :func:`classes`.
    """
    with common.scratch(docs.sparkSession) as result:
        ids, of = classes(docs, doc_id=doc_id, text=text, **options)
        firsts = ids.groupBy("node").agg(F.min("id").alias("first"))
        sized = of.join(firsts, "node").groupBy("root").agg(F.sum("n").alias("rows"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("kept")).where("rows > 1")
        of = common.stored(of.join(common.small(common.stored(sized, "sized"), BROADCAST_ROWS), "root").select("node", F.col("kept.first").alias("kept_id"), F.col("kept.node").alias("kept_node")), "kept")
        rows = ids.join(common.small(of, BROADCAST_ROWS), "node").withColumn("kept", (F.col("node") == F.col("kept_node")) & F.col("id").eqNullSafe(F.col("kept_id")))
        counted = common.stored(rows.groupBy("id", "node", "kept").agg(F.count("*").alias("n")), "rows-of-classes")
        names = common.free_name("gone_id", *docs.columns), common.free_name("gone_node", *docs.columns)
        row = lambda which: counted.where(which).select(F.col("id").alias(names[0]), F.col("node").alias(names[1]))
        gone, again = result(row("NOT kept"), "gone"), result(row("kept AND n > 1"), "again")
        on = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(names[1]))
        kept = docs.join(common.small(gone, BROADCAST_ROWS), on, "left_anti")
        if again.isEmpty():
            return kept
        repeated = common.small(again, BROADCAST_ROWS)
        return kept.join(repeated, on, "left_anti").union(kept.join(repeated, on, "left_semi").dropDuplicates([doc_id, text]))
