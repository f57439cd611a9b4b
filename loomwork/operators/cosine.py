"""Exact cosines of sparse vectors by an inverted index that prunes: rare terms first, hot terms last.

Vectors are rows (key, term, weight) of unit length, as :func:`text.tfidf` gives them. Terms have one order for both sides, by the number of
right vectors that hold them. What a vector's terms from some place on can add to a cosine is bounded by their norm, and by their
weights times the largest weight that each term has on the right. Two vectors alike enough share a term before the place where the
bound falls below what is asked for; the rarest shared one is such a term. So a hot term is opened only for vectors that have little else, and
rows with it only where their own remaining norm is large enough. Candidates are verified by whole dot products.

Null keys, terms and weights take no part; rows of one key and term are added up. Empty sides give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import result, scratch_folder, small, stored

#: Rounding that a bound must allow for; digits of a cosine, so that equal ones tie; terms and rows of each term that a query's first rows come from.
SLACK, DIGITS, SEED_TERMS, SEED_TIMES = 1e-9, 9, 8, 4


def _vectors(rows: DataFrame, key: str, name: str) -> DataFrame:
    rows = rows.select(F.col(key).alias(name), F.col("term").alias("term"), F.col("weight").cast("double").alias("w")).dropna()
    return rows.groupBy(name, "term").agg(F.sum("w").alias("w")).where("w > 0")


def _folded(vectors: DataFrame, key: str, most: int | None) -> DataFrame:
    """(key, same): each key with the smallest key of an equal vector; no more than ``most`` keys of each kind, the smallest."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "term", F.round("w", 12)).cast("decimal(38,0)"))
    prints = vectors.groupBy(key).agg(h(1).alias("p"), h(2).alias("q"), F.count("*").alias("n"))
    least = prints.groupBy("p", "q", "n").agg(F.min(key).alias("same"))
    if most is not None:
        place = F.row_number().over(Window.partitionBy("p", "q", "n").orderBy(key))
        prints = prints.withColumn("place", place).where(F.col("place") <= most)  # limited in each task before the shuffle
    return prints.join(least, ["p", "q", "n"]).select(key, "same")


def _ranked(vectors: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """Vectors with what their terms from each one on (rare ones first) have as norm and may add at most."""
    rest = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = vectors.join(terms, "term")
    norm, most = F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest)), F.sum(F.col("w") * F.col("largest")).over(rest)
    return rows.select(key, "term", "w", "largest", norm.alias("norm"), F.least(norm, most).alias("rest"))


def dots(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, cosine) of stated pairs, by joins on keys and terms."""
    a = pairs.join(left.select("l", "term", F.col("w").alias("lw")), "l")
    return a.join(right.select("r", "term", F.col("w").alias("rw")), ["r", "term"]).groupBy("l", "r").agg(F.round(F.sum(F.col("lw") * F.col("rw")), DIGITS).alias("cosine"))


def similar_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, str], least: float) -> DataFrame:
    """(left key, right key, cosine) of all pairs with a cosine of at least ``least`` (above 0), stored in the shared folder.

    Both sides are indexed up to where the remaining norm falls below ``least``. Copies of one vector make a pair each: give texts once.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    spark = left.sparkSession
    with scratch_folder(spark) as folder:
        a, b = stored(_vectors(left, keys[0], "l"), f"{folder}/l"), stored(_vectors(right, keys[1], "r"), f"{folder}/r")
        terms = stored(b.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("largest")), f"{folder}/terms")
        x, y = _ranked(a, "l", terms).where(F.col("rest") >= least - SLACK), _ranked(b, "r", terms).where(F.col("norm") >= least - SLACK)
        near = F.col("lnorm") * F.col("norm") >= least - SLACK  # at the rarest shared term both norms are what is left
        pairs = x.select("term", "l", F.col("norm").alias("lnorm")).join(y.select("term", "r", "norm"), "term").where(near).select("l", "r").distinct()
        found = dots(pairs, a, b).where(F.col("cosine") >= least)
        return result(found.select(F.col("l").alias(keys[0]), F.col("r").alias(keys[1]), "cosine"), "cosines")


def top_cosines(left: DataFrame, right: DataFrame, keys: tuple[str, str], k: int, but_self: bool = False) -> DataFrame:
    """(left key, right key, cosine, place): the ``k`` right vectors most like each left one, of those that share a term with it.

    Ties go to the smaller key; ``but_self`` leaves out a vector's own key. Stored in the shared folder. Equal vectors are one on
    either side until the end, so copies cost nothing. A query's first rows are the heaviest of its heaviest terms; the k-th best of
    them is what others must reach, and bounds the terms that are opened.
    """
    spark = left.sparkSession
    most = k + but_self
    with scratch_folder(spark) as folder:
        a, b = stored(_vectors(left, keys[0], "l"), f"{folder}/left"), stored(_vectors(right, keys[1], "r"), f"{folder}/right")
        of_left, of_right = stored(_folded(a, "l", None), f"{folder}/of-left"), stored(_folded(b, "r", most), f"{folder}/of-right")
        a, b = a.join(of_left.where("l = same"), "l").select("l", "term", "w"), b.join(of_right.where("r = same"), "r").select("r", "term", "w")
        terms = stored(b.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("largest")), f"{folder}/terms")
        x, y = stored(_ranked(a, "l", terms), f"{folder}/x"), stored(_ranked(b, "r", terms), f"{folder}/y")

        heavy = y.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "r"))).where(F.col("place") <= SEED_TIMES * most).select("term", "r")
        asked = x.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy(F.desc(F.col("w") * F.col("largest")), "term"))).where(F.col("place") <= SEED_TERMS)
        first = stored(dots(asked.select("l", "term").join(heavy, "term").select("l", "r").distinct(), a, b), f"{folder}/first")
        # copies on the right count as often as they may be given
        copies = of_right.groupBy(F.col("same").alias("r")).agg(F.count("*").alias("n"))
        order = Window.partitionBy("l").orderBy(F.desc("cosine"), "r")
        reached = first.join(copies, "r").withColumn("upto", F.sum("n").over(order)).where((F.col("upto") >= most) & (F.col("upto") - F.col("n") < most)).select("l", F.col("cosine").alias("least"))

        open_terms = stored(x.join(reached, "l", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK).where("rest >= least").select("term", "l", "norm", "least"), f"{folder}/open")
        needed = stored(open_terms.groupBy("term").agg(F.min(F.col("least") / F.col("norm")).alias("needed")), f"{folder}/needed")
        index = y.join(small(needed, 200_000), "term").where(F.col("norm") >= F.col("needed") - SLACK).select("term", "r", F.col("norm").alias("rnorm"))
        more = open_terms.join(index, "term").where(F.col("norm") * F.col("rnorm") >= F.col("least")).select("l", "r").distinct().join(first, ["l", "r"], "left_anti")
        found = first.unionByName(dots(more, a, b))
        best = found.join(copies, "r").withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
        # all that tie with the last place stay until keys decide
        last = best.where(F.col("before") < most).groupBy("l").agg(F.min("cosine").alias("last"))
        best = best.join(last, "l").where(F.col("cosine") >= F.col("last")).select(F.col("l").alias("lsame"), F.col("r").alias("rsame"), "cosine")
        every = of_left.select("l", F.col("same").alias("lsame")).join(best, "lsame").join(of_right.select("r", F.col("same").alias("rsame")), "rsame")
        if but_self:
            every = every.where("l <> r")
        place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("cosine"), "r"))
        every = every.withColumn("place", place.cast("long")).where(F.col("place") <= k)
        return result(every.select(F.col("l").alias(keys[0]), F.col("r").alias(keys[1]), "cosine", "place"), "top-cosines")
