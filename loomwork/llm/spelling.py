"""Spelling variants: words of a corpus, pairs one edit apart by a positional q-gram index, and the form that each is a variant of.

A pair of words one edit apart is equal before and after the piece in which the edit lies. Every word is therefore dealt to two
pieces, its halves, once with its own length and once as the longer word of a pair; words that agree in all but the piece meet in one
shard. A shard that would hold more than :data:`MOST_WORDS` words is dealt anew by halves of its piece, so that neither a frequent beginning nor
a frequent end comes to one task. That stays exact; a piece of one code point holds no more words than there are letters and pairs of them.

In a shard the bigrams of the pieces, with their places, form an inverted index. The postings of a word's bigrams, at places and
lengths that one edit allows, are merged by a heap; words that come up at least as often as one edit must leave are verified.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shard.
MOST_WORDS = 500
Q = 2


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, drop_one_in: int = 199) -> DataFrame:
    """(word, n): runs of letters of all whole texts, A-Z in lower case, with their numbers of occurrences.

    Where ``drop_one_in`` divides the crc32 of ``key:run``, that crc32 modulo the run's length is the place of a code point that is
    left out; under a null key nothing is left out. Null and empty texts have no words. Equal words are added up before the shuffle.
    """
    runs = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("key", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    counted = runs.select(F.when(F.pmod(h, F.lit(drop_one_in)) == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _shards(df: DataFrame, pieces) -> DataFrame:
    """``df`` (word, n) at each of its ``pieces`` (m, lo, hi): m the shorter word's length, [lo, hi) the piece of it that holds the edit."""
    at = df.select("word", "n", F.explode(pieces).alias("at")).select("word", "n", "at.m", "at.lo", "at.hi")
    rest = F.xxhash64("m", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), F.length("word") - F.col("m") + F.col("hi") + 1, F.col("m") - F.col("hi")))
    return at.withColumn("shard", rest)


def _piece(m, lo, hi):
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def one_edit(s: str, t: str) -> int | None:
    """Where ``s`` and ``t``, not longer by more than one, first differ if exactly one edit makes one the other; else None."""
    at = next((i for i, (x, y) in enumerate(zip(s, t, strict=False)) if x != y), len(s))
    if len(s) == len(t):
        return at if at < len(s) and s[at + 1 :] == t[at + 1 :] else None
    return at if s[at:] == t[at + 1 :] else None


def near_in_shard(members: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs of ``members`` (different words that agree outside the piece) whose first difference lies in the piece.

    A pair belongs to the one piece that holds its first difference, or to the last piece if that is the shorter word's end; so no
    pair comes from two shards.
    """
    pieces = [w[max(lo - 1, 0) : len(w) - m + hi + 1] for w in members]
    pieces = [("^" if lo == 0 else "") + p + ("$" if hi == m else "") for p in pieces]
    # postings: places and lengths are part of the key, so only those that one edit allows are opened; ids ascend in each
    postings: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    for i, p in enumerate(pieces):
        for at in range(len(p) - Q + 1):
            postings[p[at : at + Q], at, len(p)].append(i)
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, p in enumerate(pieces):
        by_length[len(p)].append(i)
    for i, p in enumerate(pieces):
        if len(members[i]) > m:
            continue  # a longer word is here for the shorter ones; with its like it meets where m is its own length
        grams = [(p[at : at + Q], at) for at in range(len(p) - Q + 1)]
        for longer in (0, 1):
            least = len(p) + longer - Q + 1 - Q  # of the longer's bigrams one edit changes no more than Q
            if least <= 0:
                found = iter(by_length[len(p) + longer])
            else:
                lists = [postings[k] for g, at in grams for shift in range(longer + 1) if (k := (g, at + shift, len(p) + longer)) in postings]
                found = (j for j, same in groupby(heapq.merge(*lists)) if sum(1 for _ in same) >= least)
            for j in found:
                if longer or j > i:
                    at = one_edit(members[i], members[j])
                    if at is not None and (at < hi or hi == m):
                        yield i, j


def near_pairs(vocabulary: DataFrame, most_words: int = MOST_WORDS, shortest: int = 1) -> DataFrame:
    """(word, near, near_n): all pairs of words one edit apart, both ways, each once. ``vocabulary`` (word, n) has distinct words, none shorter than ``shortest``."""
    length, parts = F.length("word"), []
    halves = lambda m: (_piece(m, F.lit(0), F.floor(m / 2)), _piece(m, F.floor(m / 2), m))
    pieces = F.filter(F.array(*halves(length), *halves(length - 1)), lambda p: (p.hi > p.lo) & (p.m >= shortest))
    todo = common.stored(_shards(vocabulary.select("word", "n"), pieces), "shards")
    while True:
        # a piece of one code point is not cut further; longer ones are while too many words share the rest
        large = common.stored(todo.where("hi > lo + 1").groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > most_words).select("shard"), "large-shards")
        if large.isEmpty():
            parts.append(_pairs_of(todo))
            break
        large = common.small(large, 100_000)
        parts.append(_pairs_of(todo.join(large, "shard", "left_anti")))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        again = todo.join(large, "shard").select("word", "n", F.array(_piece(F.col("m"), F.col("lo"), middle), _piece(F.col("m"), middle, F.col("hi"))).alias("pieces"))
        todo = common.stored(_shards(again, F.col("pieces")), "shards")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _pairs_of(shards: DataFrame) -> DataFrame:
    columns = ["shard", "m", "lo", "hi", "word", "n"]
    dealt = shards.select(*columns).repartition("shard").sortWithinPartitions("shard", "m", "lo", "hi", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: tuple[list, list, list] = ([], [], [])
        for (_, m, lo, hi), group in groupby(rows, lambda r: r[:4]):
            group = list(group)  # a shard, bounded by MOST_WORDS or the alphabet
            members, counts = [r[4] for r in group], [r[5] for r in group]
            if len(members) == 1:
                continue
            for i, j in near_in_shard(members, m, lo, hi):
                for a, b in ((i, j), (j, i)):
                    out[0].append(members[a])
                    out[1].append(members[b])
                    out[2].append(counts[b])
                if len(out[0]) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
                    out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])

    common.small_batches(shards.sparkSession)
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) by following (word, form) to the last form; steps double each round. Forms must not run in circles."""
    links = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = common.stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")
    raise RuntimeError("forms run in circles")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, drop_one_in: int = 199, times: int = 5, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word, stored in the shared folder; see :func:`words` for what a word is.

    A word's form is its most frequent near word (ties: the first by code points) if that is at least ``times`` as frequent; its root is
    the last form that forms lead to, itself if it has none. An empty table, or one without words, gives an empty result; repeated rows
    count again; other columns take no part.
    """
    with common.scratch(docs.sparkSession) as result:
        vocabulary = common.stored(words(docs, key, text, least_length, least_count, drop_one_in), "words")
        near = near_pairs(vocabulary, most_words, least_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
        found = vocabulary.join(near, "word", "left")
        has = -F.col("best.n") >= times * F.col("n")
        found = common.stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")), "forms")
        last = roots(found.where("form IS NOT NULL"))
        return result(found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
