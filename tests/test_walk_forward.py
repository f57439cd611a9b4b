"""The walk-forward table function."""

import datetime as dt

import pytest

from loomwork.functions.walk_forward import register_walk_forward


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def view(spark):
    rows = [(k, month(i), (100 + i if k == "a" else i * i) if i != 30 else None) for k in ("a", "b") for i in range(40)] + [("short", month(i), 1) for i in range(10)] + [(None, month(i), i) for i in range(31)]
    spark.createDataFrame(rows, "series string, period date, value int").repartition(3).createOrReplaceTempView("wf_rows")
    register_walk_forward(spark, "mean_folds", lambda values, n: [sum(v for v in values if v is not None) / max(1, sum(v is not None for v in values))] * n)
    register_walk_forward(spark, "wrong_folds", lambda values, n: [0.0])


CALL = "SELECT * FROM {f}(TABLE(wf_rows) PARTITION BY series ORDER BY period, key => '{key}', period => 'period', value => '{value}', min_train => 24, test_size => 6, step => 5{more})"


def call(spark, f="mean_folds", key="series", value="value", more=""):
    return spark.sql(CALL.format(f=f, key=key, value=value, more=more))


@pytest.mark.parametrize("more", ["", ", mode => 'rolling', train_rows => 7"])
def test_folds_equal_a_loop(spark, view, more):
    got = {(r.key, r.fold, r.step): (r.period, r.actual, r.predicted) for r in call(spark, more=more).collect()}
    want = {}
    for k, n in (("a", 40), ("b", 40), (None, 31)):
        values = [None if i == 30 and k else float(100 + i if k == "a" else i * i if k == "b" else i) for i in range(n)]
        for fold, origin in enumerate(range(24, n - 5, 5)):
            train = [v for v in values[max(0, origin - 7) if more else 0 : origin] if v is not None]
            for s in range(6):
                want[k, fold, s + 1] = (month(origin + s), values[origin + s], sum(train) / len(train))
    assert got == want


def test_types_follow_the_table(spark, view):
    assert dict(call(spark).dtypes) == {"key": "string", "fold": "int", "step": "int", "period": "date", "actual": "double", "predicted": "double"}


@pytest.mark.parametrize(("given", "message"), [({"key": "nokey"}, "no column"), ({"value": "period"}, "no number"), ({"more": ", mode => 'odd'"}, "expanding or rolling"), ({"more": ", train_rows => 0"}, "at least 1")])
def test_wrong_calls_fail_before_they_run(spark, view, given, message):
    with pytest.raises(Exception, match=message):
        call(spark, **given)


def test_too_few_predictions_are_an_error(spark, view):
    with pytest.raises(Exception, match="predictions for 6 rows"):
        call(spark, "wrong_folds").collect()
