"""Each shop's best firm by equi-joins alone, exact for the whole score; neither side is collected.

Equal shops and equal firms (words, compact name, brands) are one on their side; of equal firms the smallest id counts.

Containment is decided by keys. A brand, a firm's word or a shop's word gives all firms behind it one score, so the smallest firm id
of each is worked out before the join; a word inside a name is found by the name's stretches of words' lengths.

The rest needs the blend, which falls with the number of characters (with repetition) that two names share. For each name the
least number is computed that any partner must share for its score to reach what is asked: the threshold, or a containment that the shop has
already. By the prefix principle two names that share so many have two of the rarest characters of both prefixes in common: pairs of
characters are the keys. Very short names, which may share a single character, and very long ones, whose pairs would be many, meet by
single characters. Pairs that meet are held against the bound and scored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching as M
from .shared import result, scratch_folder, small, stored

#: Characters that are told apart; all others count as one, which only raises what two names seem to share.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Longest stretch that is a key; longer words are found by their beginning. Names longer than LONG meet others by single characters.
STRETCH, LONG, LEAST_PARTNER = 64, 60, 12
ALL_BRANDS = tuple(sorted({b for bs in M.BRANDS.values() for b in bs}))
#: Containment scores, none of which is below SURE.
SURE = 0.90
ROUNDING = 1e-9


def bound(shared, a, b, spaces_a, spaces_b, spaced):
    """The highest blend of names of ``a`` and ``b`` characters (and spaces between words) that share so many characters.

    ``spaced``: whether both have words; names of noise alone have none.
    """
    ratio = np.minimum(1.0, 2 * shared / (a + b))
    common = np.minimum(spaces_a, spaces_b)
    words = np.where(spaced, np.minimum(1.0, 2 * (shared + common) / (a + b + spaces_a + spaces_b)), 0.0)
    return 0.45 * ratio + 0.35 * words + 0.20 * np.minimum(1.0, 2 * shared / np.maximum(np.minimum(a, b) + shared, 1))


@lru_cache(maxsize=100_000)
def least_shared(n: int, spaces: int, least: float) -> int:
    """The fewest characters that a name of ``n`` must share with any partner for a blend of ``least``; n + 1 if none is enough."""
    b = np.arange(1, 8 * n + 17)
    low, high = np.zeros(len(b), dtype=np.int64), np.minimum(n, b)  # bisection: the bound rises with what is shared
    # the partner's words may be as the name's own: that bounds the blend most loosely
    fine = lambda o: bound(o, n, b, np.minimum(spaces, b - 1), np.minimum(spaces, b - 1), True) >= least - ROUNDING
    possible = fine(high)
    if not possible.any():
        return n + 1
    while (high - low > 1).any():
        middle = (low + high) // 2
        ok = fine(middle)
        low, high = np.where(ok, low, middle), np.where(ok, middle, high)
    return int(high[possible].min())


def prefix(name: str, order: dict[str, int], length: int) -> list[str]:
    """The ``length`` rarest of a name's characters, each with how many such there are before it: later ones first, then rarer characters."""
    seen: dict[str, int] = {}
    tokens = []
    for c in name:
        c = c if c in order else "*"
        seen[c] = seen.get(c, 0) + 1
        tokens.append((-seen[c], order.get(c, 0), c))
    tokens.sort()
    return [f"{c}{-k}" for k, _, c in tokens[:length]]


def keys_of(name: str, spaces: int, least: float, order: dict[str, int], side: str) -> list[str]:
    """The keys under which a name meets all partners that may reach ``least``; ``side`` is shop or firm."""
    n = len(name)
    need = least_shared(n, spaces, least) if n else 1
    if n == 0 or need > n:
        return []
    single = prefix(name, order, n - need + 1)
    out = [f"1:{t}" for t in single] if need == 1 else []
    if n <= LONG:
        out += [f"2:{a}{b}" for a, b in combinations(sorted(prefix(name, order, n - need + 2)), 2)]
    if n >= LEAST_PARTNER:  # a long name, on either side
        out += [f"{side}:{t}" for t in single] if n > LONG else []
        out += [f"{'firm' if side == 'shop' else 'shop'}:{t}" for t in single]
    return out


def _keys(name: Column, words: Column, least: Column, order: dict[str, int], side: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(names: pd.Series, spaces: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([keys_of(a, int(b), float(c), order, side) for a, b, c in zip(names, spaces, least, strict=True)])

    return run(name, F.greatest(F.size(words) - 1, F.lit(0)), least)


def _blends(*columns: Column) -> Column:
    """The blend or brand ratio of pairs; 0 where shared characters rule out that it reaches ``least``."""

    @F.pandas_udf("double")
    def run(firm: pd.Series, shop: pd.Series, firm_words: pd.Series, shop_words: pd.Series, firm_brands: pd.Series, least: pd.Series) -> pd.Series:
        out = []
        for f, s, fw, sw, b, t in zip(firm, shop, firm_words, shop_words, firm_brands, least, strict=True):
            shared = sum(min(f.count(c), s.count(c)) for c in set(f) & set(s))
            possible = bound(shared, len(f), len(s), max(len(fw) - 1, 0), max(len(sw) - 1, 0), len(fw) > 0 and len(sw) > 0) >= t - ROUNDING
            out.append(min(1.0, max(M.blend(f, s, fw, sw) if possible else 0.0, M.brand_ratio(b, s))))
        return pd.Series(out, dtype=float)

    return run(*columns)


def _near_brands(shop: Column, least: Column) -> Column:
    """(brand, ratio) of the long brands whose ratio with a handle reaches ``least``."""

    @F.pandas_udf("array<struct<brand:string,ratio:double>>")
    def run(shops: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([[{"brand": b, "ratio": r} for b in ALL_BRANDS if (r := M.brand_ratio([b], s)) >= t - ROUNDING] if s else [] for s, t in zip(shops, least, strict=True)])

    return run(shop, least)


def _key(words: str, compact: str, *more: str) -> Column:
    return F.concat_ws("|", F.array_join(words, " "), compact, *(F.array_join(c, " ") for c in more))


def _stretches(rows: DataFrame, key: str, compact: str, lengths: list[int]) -> DataFrame:
    """(key, compact, part): the stretches of names that may be words of these lengths, or begin longer ones."""
    at = rows.where(F.length(compact) >= min(lengths, default=1)).select(key, compact, F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where(F.length(compact) >= F.col("n"))
    return at.select(key, compact, F.explode(F.transform(F.sequence(F.lit(1), F.length(compact) - F.col("n") + 1), lambda i: F.substring(F.col(compact), i, F.col("n")))).alias("part")).distinct()


def _words(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, word, part): words that may stand inside a name."""
    every = rows.select(key, F.explode(F.array_distinct(words)).alias("word")).where(F.length("word") >= M.LEAST_TOKEN)
    return every.withColumn("part", F.substring("word", 1, STRETCH))


def _lengths(words: DataFrame) -> list[int]:
    """Lengths of parts, no more than the longest stretch."""
    return sorted(r[0] for r in words.select(F.length("part")).distinct().collect())


def _contained(s: DataFrame, f: DataFrame) -> DataFrame:
    """(skey, score, firm): the best containment of each shop, and the smallest firm that has it."""
    brand = f.select("fid", F.explode("firm_brands").alias("brand")).groupBy("brand").agg(F.min("fid").alias("firm"))  # no more rows than brands
    by_brand = s.select("skey", "shop_compact", F.explode(F.array(*map(F.lit, ALL_BRANDS))).alias("brand")).withColumn("score", M.brand_tier(F.col("brand"), F.col("shop_compact"))).where("score > 0")
    parts = [by_brand.join(F.broadcast(brand), "brand").select("skey", "score", "firm")]
    inside = F.lit(0.92)
    firm_words = _words(f.select("fid", "firm_words"), "fid", "firm_words").groupBy("word", "part").agg(F.min("fid").alias("firm"))
    in_shop = _stretches(s, "skey", "shop_compact", _lengths(firm_words)).join(firm_words, "part").where(F.contains("shop_compact", F.col("word")))
    parts.append(in_shop.select("skey", inside.alias("score"), "firm"))
    shop_words = _words(s, "skey", "shop_words")
    distinct = shop_words.select("word", "part").distinct()
    in_firm = _stretches(f.select("fid", "firm_compact"), "fid", "firm_compact", _lengths(shop_words)).join(distinct, "part").where(F.contains("firm_compact", F.col("word"))).groupBy("word").agg(F.min("fid").alias("firm"))
    parts.append(shop_words.join(in_firm, "word").select("skey", inside.alias("score"), "firm"))
    best = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("skey").agg(F.min(F.struct((-F.col("score")).alias("worst"), F.col("firm").alias("firm"))).alias("b"))
    return best.select("skey", (-F.col("b.worst")).alias("score"), F.col("b.firm").alias("firm"))


def resolve(shops: DataFrame, firms: DataFrame, shop_id: str, shop: str, firm_id: str, name: str, threshold: float = M.THRESHOLD) -> DataFrame:
    """(shop id, firm id, score): a row for each row of ``shops`` with its best firm of at least ``threshold``; null without one.

    Ties go to the smallest firm id. Firms without an id take no part; null and empty names match nothing. Stored in the shared folder.
    """
    if not 0.6 <= threshold <= SURE:
        raise ValueError("thresholds lie between 0.6 and 0.9")
    spark = shops.sparkSession
    signed = M.signals(shops.select(F.col(shop_id).alias("sid"), F.col(shop).alias("shop")), "shop", M.SHOP_NOISE, "shop")
    signed = signed.select("sid", _key("shop_words", "shop_compact").alias("skey"), "shop_words", "shop_compact")
    known = M.signals(firms.select(F.col(firm_id).alias("fid"), F.col(name).alias("name")).where("fid IS NOT NULL"), "name", M.FIRM_NOISE, "firm").withColumn("firm_brands", F.array_sort(M.brands(F.col("name"))))
    known = known.groupBy(_key("firm_words", "firm_compact", "firm_brands").alias("fkey"), "firm_words", "firm_compact", "firm_brands").agg(F.min("fid").alias("fid"))
    with scratch_folder(spark) as folder:
        s = stored(signed.where("shop_compact <> ''").select("skey", "shop_words", "shop_compact").distinct(), f"{folder}/shops")
        f = stored(known, f"{folder}/firms")
        sure = stored(_contained(s, f), f"{folder}/contained")
        s = stored(s.join(sure.select("skey", F.col("score").alias("sure")), "skey", "left").withColumn("least", F.greatest(F.lit(float(threshold)), F.coalesce("sure", F.lit(0.0)))), f"{folder}/asked")

        # rare characters first; counts of 36 characters
        counts = f.agg(*(F.coalesce(F.sum(F.length("firm_compact") - F.length(F.translate("firm_compact", c, ""))), F.lit(0)) for c in COUNTED)).first()
        order = {c: i + 1 for i, (_, c) in enumerate(sorted(zip(counts, COUNTED, strict=True)))}
        left = s.select("skey", F.explode(_keys(F.col("shop_compact"), F.col("shop_words"), F.col("least"), order, "shop")).alias("key"))
        right = f.select("fkey", F.explode(_keys(F.col("firm_compact"), F.col("firm_words"), F.lit(float(threshold)), order, "firm")).alias("key"))
        pairs = left.join(right, "key").select("skey", "fkey")

        # a brand's ratio: one firm stands for all where containment could not be less; above that each firm is scored
        near = stored(s.select("skey", F.explode(_near_brands(F.col("shop_compact"), F.col("least"))).alias("b")).select("skey", "b.brand", "b.ratio"), f"{folder}/near-brands")
        by_brand = f.select("fkey", "fid", F.explode("firm_brands").alias("brand"))
        least_firm = by_brand.groupBy("brand").agg(F.min(F.struct("fid", "fkey")).alias("m")).select("brand", "m.fid", "m.fkey")  # no more rows than brands
        one = near.where(F.col("ratio") <= SURE).join(F.broadcast(least_firm), "brand").select("skey", "fkey")
        each = near.where(F.col("ratio") > SURE).join(small(stored(by_brand, f"{folder}/brands"), 100_000), "brand").select("skey", "fkey")

        pairs = pairs.unionByName(one).unionByName(each).distinct().join(s, "skey").join(f, "fkey").withColumn("tier", M.tiers()).where("tier IS NULL")
        blended = pairs.withColumn("score", _blends(F.col("firm_compact"), F.col("shop_compact"), F.col("firm_words"), F.col("shop_words"), F.col("firm_brands"), F.col("least")))
        found = blended.where(F.col("score") >= threshold).select("skey", "score", F.col("fid").alias("firm")).unionByName(sure.where(F.col("score") >= threshold))
        best = found.groupBy("skey").agg(F.min(F.struct((-F.col("score")).alias("worst"), F.col("firm").alias("firm"))).alias("b"))
        rows = signed.select("sid", "skey").join(best, "skey", "left")
        return result(rows.select(F.col("sid").alias(shop_id), F.col("b.firm").alias(firm_id), (-F.col("b.worst")).alias("score")), "resolved")
