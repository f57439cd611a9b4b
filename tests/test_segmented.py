"""Series over many segments against the windows of one task."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import windows as W
from loomwork.operators.segmented import Segmented, asof_backward


def series(spark, n):
    gone = (F.col("id") % 11 < 2) | (F.col("id") % 997 < 40) | ((F.col("id") > n * 0.4) & (F.col("id") < n * 0.62)) | (F.col("id") > n - 30) | (F.col("id") < 5)
    return spark.range(n).select((F.col("id") * 3).alias("period"), F.when(~gone, F.round(F.sin(F.col("id") / 50) * 100 + 200, 3)).alias("value"), F.lit("x").alias("other"))


def plain(df, keys):
    g = W.growth(W.rolling_means(W.lags(df, keys, "value"), keys, "value"), keys, "value", "growth")
    return W.gaps_filled(W.gap_lengths(g, keys, "value"), keys, "value", max_gap=3)


def parts(df, keys, rows):
    return Segmented(df, keys, rows=rows).lags("value").rolling_means("value").growth("value", "growth").gaps_filled("value", max_gap=3)


def differing(a, b, names):
    """Whether two frames differ as bags of rows (numbers to nine digits): by their number and sums of two hashes."""
    kinds = dict(a.dtypes)
    like = [F.round(c, 9) + F.lit(0.0) if kinds[c] == "double" else F.col(c) for c in names]
    mark = lambda df: df.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(i), *like).cast("decimal(38,0)")) for i in (1, 2))).first()
    return mark(a) != mark(b)


def test_one_series_of_a_million_rows(spark):
    n = 1_000_000
    df = series(spark, n)
    s = parts(df.repartition(7), [], 100_000)
    assert s.rows.select(s.segment).distinct().count() >= 10
    assert s.rows.groupBy(s.segment).count().agg(F.max("count")).first()[0] < 200_000
    want = plain(df.withColumn("one", F.lit(0)), ["one"]).drop("one")
    assert s.df.count() == n and differing(s.df, want, s.columns) == 0
    assert set(s.columns) == set(want.columns)


@pytest.mark.parametrize("rows", [3, 40, 10_000])
def test_many_series_over_few_rows(spark, rows):
    """Segments shorter than what lags look back to, series with one row, null keys."""
    df = series(spark, 220).withColumn("k", F.when(F.col("period") % 5 > 0, F.when(F.col("period") % 7 == 0, "b").otherwise("a")))
    df = df.unionByName(spark.createDataFrame([(1, 2.0, "x", "lone"), (2, None, "x", "void"), (3, None, "x", "void")], "period long, value double, other string, k string"))
    s = parts(df, ["k"], rows)
    assert differing(s.df, plain(df, ["k"]), s.columns) == 0


def test_asof_over_segments(spark):
    right = spark.range(0, 30_000, 37).select(F.col("id").alias("period"), (F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"))
    left = spark.range(100, 30_000).select(F.col("id").alias("period"), (F.col("id") % 4).cast("string").alias("k"), F.lit(9).alias("b"), (F.col("id") * 2).alias("side"))
    right = right.unionByName(spark.createDataFrame([(20_000, "3", 5)], "period long, k string, b long"))  # nothing before for long
    want = W.asof_backward(left.drop("b"), right, ["k"], ["b"])
    got = asof_backward(left, right, ["k"], ["b"], rows=1000)
    assert differing(got, want, want.columns) == 0 and got.count() == left.count()


def test_empty_and_clashing(spark):
    df = series(spark, 10)
    assert parts(df.where("false"), [], 5).df.isEmpty()
    again = Segmented(df.withColumn("value_lag1", F.lit("old")), [], rows=4).lags("value", (1,)).df
    assert dict(again.dtypes)["value_lag1"] == "double"
    with pytest.raises(ValueError, match="rename"):
        Segmented(df.withColumnRenamed("other", "total"), [], rows=4).gaps_filled("value")
