import datetime as dt

import pytest

from loomwork.operators import cleaning as C


def frame(spark, values):
    return spark.createDataFrame([("a", dt.date(2000, 1, 1) + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], "k string, period date, value double")


def flags(df):
    return [r.is_outlier for r in df.orderBy("period").collect()]


def test_iqr_flags_only_the_outlier(spark):
    assert flags(C.with_fences(frame(spark, [10, 11, 12, 10.5, 11.5, 100, None]), ["k"], "value")) == [False] * 5 + [True, False]


def test_zscore(spark):
    assert sum(flags(C.with_fences(frame(spark, [10] * 30 + [1000, None]), ["k"], "value", method="zscore"))) == 1


def test_no_spread_no_outlier(spark):
    assert not any(flags(C.with_fences(frame(spark, [5, 5, 5, 5]), ["k"], "value")))


@pytest.mark.parametrize("action", ["median", "winsorize", "null"])
def test_actions(spark, action):
    values = [10, 11, 12, 10.5, 11.5, 10.2, 11.1, 12.2, 10.8, 200]
    last = C.clean_series(frame(spark, values), ["k"], action=action).orderBy("period").collect()[-1]
    assert last.is_outlier
    assert {"median": last.value_clean == pytest.approx(11.05), "null": last.value_clean is None, "winsorize": 12.2 < (last.value_clean or 0) < 20}[action]


def test_codes(spark):
    rows = spark.createDataFrame([("2740",), (" 2740 ",), (None,), ("",), ("2799",), ("9999",), ("C",)], "code string")
    out = C.validate_codes(rows, spark.createDataFrame([("2740",)], "v string"), "code")
    assert sorted((r.code or "", r.reason) for r in out.collect() if r.reason) == [("", "missing_code"), ("", "missing_code"), ("2799", "unknown_code"), ("9999", "not_section_c"), ("C", "unknown_code")]
    assert C.validation_summary(out).first().asDict() == {"checked": 7, "valid": 2, "n_missing_code": 2, "n_unknown_code": 2, "n_not_section_c": 1}


def test_listing_notes_are_written_once(spark):
    rows = spark.createDataFrame([(i, str(v), None) for i, v in enumerate([10, 11, 12, 10.5, 11.5, 1000])] + [(9, "n/a", "x")], "id int, price string, notes string")
    once = C.clean_listings(rows, ["price"])
    twice = C.clean_listings(once.drop("price_outlier"), ["price"])
    notes = {r.id: r.notes for r in twice.collect()}
    assert notes[5] == "outlier:price"
    assert notes[9] == "x"
    assert {r.id: r.price for r in once.collect()}[9] is None
