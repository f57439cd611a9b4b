"""Scores of shops and firms: containment tiers as column expressions, Indel ratios in Arrow batches on what they leave, fusion."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

#: The score from which a shop is a firm's, the shortest token that may stand inside a handle, and words that tell nothing.
THRESHOLD, LEAST_TOKEN = 0.65, 5
#: The shortest brand that is held against a handle by ratios, and what its partial ratio counts.
LEAST_BRAND, BRAND_PARTIAL = 5, 0.85
FIRM_NOISE = ("cong", "ty", "cty", "cp", "co", "phan", "tap", "doan", "tnhh", "joint", "stock", "company", "corp", "corporation", "group", "the", "va", "and", "cua", "nganh", "nghiep", "viet", "nam", "vietnam", "dien", "dong")
SHOP_NOISE = ("official", "store", "shop", "vn", "vietnam", "viet", "nam", "consumer", "mall", "flagship", "global", "online")
#: Marks in firm names and the shop brands that they stand for.
BRANDS = {
    "rang dong": ("rangdong",), "bong den": ("rangdong",), "sua viet nam": ("vinamilk",), "fpt": ("fpt",), "masan": ("masan",), "phu nhuan": ("pnj",), "vang bac": ("pnj",),
    "dien quang": ("dienquang", "dienquangofficialstore"), "hoa phat": ("hoaphat",), "duc giang": ("ducgiang", "ducgiangchem"), "cong nghiep cao su": ("gvr", "caosuvietnam"), "co dien lanh": ("ree", "reecorp"),
    "nhua binh minh": ("bmp", "binhminh", "nhuabinhminh"), "vinh hoan": ("vinhhoan",), "nam viet": ("namviet", "navicorp"), "an phat": ("anphat", "anphatbioplastics"),
}
#: Short codes that open a handle and the brands that they stand for.
CODES = {"rd": ("rangdong",), "dq": ("dienquang", "dienquangofficialstore"), "vnm": ("vinamilk",), "hpg": ("hoaphat",), "bmp": ("bmp", "binhminh", "nhuabinhminh"), "pnj": ("pnj",), "msn": ("masan",), "fpt": ("fpt",)}


def indel(a: str, b: str) -> float:
    """2 * longest common subsequence / both lengths; bit-parallel over Python's integers."""
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of its length (or at an edge) of the longer one."""
    a, b = sorted((a, b), key=len)
    n = len(a)
    return max((indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b))), default=0.0)


def blend(firm: str, shop: str, firm_words: list[str], shop_words: list[str]) -> float:
    """0.45 of the ratio, 0.35 of that of sorted words and 0.20 of the best partial one."""
    if not firm or not shop:
        return 0.0
    return 0.45 * indel(firm, shop) + 0.35 * indel(" ".join(sorted(firm_words)), " ".join(sorted(shop_words))) + 0.20 * partial(firm, shop)


def brand_ratio(firm_brands: list[str], shop: str) -> float:
    """The best ratio, or discounted partial ratio, of a long brand of the firm with the handle."""
    return max((max(indel(b, shop), BRAND_PARTIAL * partial(b, shop)) for b in firm_brands if len(b) >= LEAST_BRAND), default=0.0)


def fuzzy(firm: str, shop: str, firm_words: list[str], shop_words: list[str], firm_brands: list[str]) -> float:
    """The score of a pair that no containment decides."""
    return min(1.0, max(blend(firm, shop, firm_words, shop_words), brand_ratio(firm_brands, shop))) if firm and shop else 0.0


def blended(*columns: str) -> Column:
    @F.pandas_udf("double")
    def batch(firm: pd.Series, shop: pd.Series, firm_words: pd.Series, shop_words: pd.Series, firm_brands: pd.Series) -> pd.Series:
        return pd.Series(list(map(fuzzy, firm, shop, firm_words, shop_words, firm_brands)), dtype=float)

    return batch(*columns)


def brands(name: Column) -> Column:
    n = X.normalized(name)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(n.contains(k), F.array(*map(F.lit, v))).otherwise(none) for k, v in BRANDS.items())))


def signals(df: DataFrame, name: str, noise: tuple[str, ...], prefix: str) -> DataFrame:
    """Words without noise and the words run together (all words of a name that is noise alone)."""
    df = df.withColumn(f"{prefix}_words", X.tokens(F.col(name), noise))
    return df.withColumn(f"{prefix}_compact", F.when(F.size(f"{prefix}_words") > 0, F.array_join(f"{prefix}_words", "")).otherwise(F.array_join(X.tokens(F.col(name)), "")))


def brand_tier(b: Column, s: Column) -> Column:
    """The containment score of one brand and a handle; 0 where neither holds the other."""
    return F.when(s == "", 0.0).when(b == s, 1.0).when((F.length(b) >= 4) & s.contains(b), 0.95).when((F.length(b) >= 4) & b.contains(s), 0.90).when((F.length(b) >= 3) & s.contains(b), 0.92).otherwise(0.0)


def tiers(shop: str = "shop_compact") -> Column:
    """The highest containment score of a pair; null where none applies."""
    s = F.col(shop)
    brand = F.transform("firm_brands", lambda b: brand_tier(b, s))
    long = lambda t: F.length(t) >= LEAST_TOKEN
    inside = F.exists("firm_words", lambda t: long(t) & s.contains(t)) | F.exists("shop_words", lambda t: long(t) & F.col("firm_compact").contains(t))
    best = F.greatest(F.coalesce(F.array_max(brand), F.lit(0.0)), F.when(inside, 0.92).otherwise(0.0))
    return F.when(best > 0, best)


def short_code(shop: Column, firm_brands: Column) -> Column:
    """0.72 where a handle opens with the short code of one of the firm's brands."""
    words = X.tokens(shop)

    def opens(code: str):
        return lambda w: (w == code) if len(code) <= 2 else w.startswith(code)

    hits = [F.arrays_overlap(firm_brands, F.array(*map(F.lit, b))) & F.exists(words, opens(c)) for c, b in CODES.items()]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    return F.when(any_hit, 0.72).otherwise(0.0)


def fused(fuzzy: Column, vector: Column, code: Column) -> Column:
    """One score of three: the higher of fuzzy and code, lifted where the vectors agree."""
    out = F.greatest(
        fuzzy, code,
        F.when((fuzzy >= 0.60) & (vector >= 0.45), fuzzy + 0.50 * F.greatest(vector - 0.40, F.lit(0.0))),
        F.when((fuzzy >= 0.35) & (vector >= 0.55), 0.35 * fuzzy + 0.65 * vector),
        F.when((code >= 0.70) & (vector >= 0.30), 0.55 * code + 0.45 * F.greatest(vector, fuzzy)),
    )
    return F.least(out, F.lit(1.0))


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with ``score``: tiers where one applies, else the blend or a brand's ratio."""
    pairs = pairs.withColumn("tier", tiers())
    sure = pairs.where("tier IS NOT NULL").withColumn("score", F.col("tier"))
    rest = pairs.where("tier IS NULL").withColumn("score", blended("firm_compact", "shop_compact", "firm_words", "shop_words", "firm_brands"))
    return sure.unionByName(rest).drop("tier")
