import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwork.operators import windows as W


def series(spark, values, key="a", start=dt.date(2020, 1, 1)):
    rows = [(key, dt.date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, period date, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("period").collect()]


@pytest.mark.parametrize(
    ("values", "options", "want"),
    [
        ([10, None, None, 40], {"long_gaps": False}, [10, 20, 30, 40]),
        ([10, None, None, None, 50], {"long_gaps": False}, [10, None, None, None, 50]),
        ([0, None, None, None, 4], {"long_gaps": False, "max_gap": 3}, [0, 1, 2, 3, 4]),
        ([10, None, None, None, 50], {}, [10, 20, 30, 40, 50]),
        ([None, 1, None], {}, [None, 1, 1]),
        ([None, 1, None], {"fill_trailing": False}, [None, 1, None]),
    ],
)
def test_gaps(spark, values, options, want):
    df = series(spark, [None if v is None else float(v) for v in values])
    assert column(W.gaps_filled(df, ["k"], "value", **options), "value_filled") == want


def test_fill_kinds(spark):
    df = series(spark, [10.0, None, None, None, 50.0, None, 70.0])
    out = W.gaps_filled(df, ["k"], "value")
    assert column(out, "fill_kind") == ["observed", "long", "long", "long", "observed", "short", "observed"]
    assert column(out, "value_filled")[5] == 60


def test_lags_rolls_growth(spark):
    df = W.growth(W.rolling_means(W.lags(series(spark, [1.0, None, 2.0, 4.0]), ["k"], "value"), ["k"], "value"), ["k"], "value", "g")
    assert column(df, "value_lag1") == [None, 1, None, 2]
    assert column(df, "value_roll3m") == [1, 1, 1.5, 3]
    assert column(df, "g") == [None, 0, 1, 1]


def test_growth_of_zero_is_null(spark):
    assert column(W.growth(series(spark, [0.0, 1.0]), ["k"], "value", "g"), "g") == [None, None]


def test_quarters_to_months(spark):
    q = spark.createDataFrame([("a", dt.date(2023, 1, 1), 10.0), ("a", dt.date(2023, 4, 1), 40.0)], "k string, period date, value double")
    assert column(W.quarters_to_months(q, ["k"]), "value") == [10, 20, 30, 40, 40, 40]


def test_step_hold_a_year(spark):
    out = W.step_held(spark.createDataFrame([(dt.date(2020, 1, 1), 0.02), (dt.date(2021, 1, 1), 0.03)], "period date, value double"), 12)
    assert column(out, "value") == [0.02] * 12 + [0.03] * 12


def test_year_on_year(spark):
    df = series(spark, [1_200_000.0, *[None] * 11, 1_306_000.0], start=dt.date(2023, 6, 1))
    assert column(W.month_on_month(df, ["k"], "value"), "yoy_pct")[-1] == pytest.approx((1_306_000 - 1_200_000) / 1_200_000 * 100)


def test_asof_takes_the_last_row_at_or_before(spark):
    left = series(spark, [0.0] * 4).select("k", "period")
    right = spark.createDataFrame([("a", dt.date(2020, 2, 1), 1.0), ("a", dt.date(2020, 4, 1), 2.0)], "k string, period date, x double")
    assert column(W.asof_backward(left, right, ["k"], ["x"]), "x") == [None, 1, 1, 2]


def test_folds_do_not_leak(spark):
    folds = W.walk_forward(series(spark, [float(i) for i in range(60)], start=dt.date(2020, 1, 1)), ["k"], min_train=48, test_size=6, step=6)
    rows = folds.groupBy("fold", "role").agg(F.min("period").alias("a"), F.max("period").alias("b"), F.count("*").alias("n")).collect()
    by = {(r.fold, r.role): r for r in rows}
    assert {f for f, _ in by} == {0, 1}
    for f in (0, 1):
        assert by[f, "train"].b < by[f, "test"].a
        assert by[f, "test"].n == 6
    assert by[0, "train"].n == 48


def test_fixed_split(spark):
    df = series(spark, [float(i) for i in range(60)])
    n = {r.role: r["count"] for r in W.fixed_split(df, "2023-12", "2024-01").groupBy("role").count().collect()}
    assert n == {"train": 48, "test": 12}
    with pytest.raises(ValueError):
        W.fixed_split(df, "2024-01", "2023-12")


def test_empty_frames(spark):
    empty = series(spark, [])
    assert W.gaps_filled(empty, ["k"], "value").count() == 0
    assert W.walk_forward(empty, ["k"]).count() == 0
    assert W.quarters_to_months(empty, ["k"]).count() == 0


def test_lag_violations_of_large_values(spark, tmp_path):
    """Errors of 1 in values of billions are found, and nothing else."""
    rows = [(m, dt.datetime(2020, m, 1), 5e9 + m / 100, "1-URGENT") for m in range(1, 13)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in entry.queries()["lag_identity_violations"](spark, str(tmp_path)).collect()]
    assert got == [("1-URGENT", dt.date(2020, 7, 1), 5e9 + 0.05 + 1)]
