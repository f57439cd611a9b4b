import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import cleaning as C
from loomwork.operators import jobs as J
from loomwork.operators import matching as M
from loomwork.operators import text as X
from loomwork.operators import training as TR
from loomwork.sources import payloads as P


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


@pytest.fixture
def monthly(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(60).cumsum()
    rows = [("with", month(i), float(5 * x[i] + 0.3 * i + 0.05 * rng.randn()), float(x[i])) for i in range(60)]
    rows += [("short", month(i), float(i), 1.0) for i in range(20)] + [("gappy", month(i), None if i == 9 else float(i), 1.0) for i in range(40)] + [("none", month(i), float(100 + i + i % 3), None) for i in range(40)]
    return spark.createDataFrame(rows, "series string, period date, value double, indigo double")


def test_arima_with_exogenous_columns(monthly):
    kept = TR.train_arima(monthly, "series", ("indigo",)).cache()
    got = {r.series: r for r in kept.collect()}
    assert (got["with"].status, got["with"].kind, got["with"].n_train, got["with"].n_test) == ("ok", "arimax", 48, 12)
    assert got["with"].beta[0] == pytest.approx(5, abs=0.1)
    assert got["short"].status == "insufficient_data"
    assert got["gappy"].status == "ok" and got["gappy"].mae < 0.01  # the month that is missing is predicted over
    assert (got["none"].kind, got["none"].n_train, got["none"].n_test) == ("arima", 34, 6)  # no fixed months there: the last six
    plain = {r.series: r for r in TR.train_arima(monthly, "series").collect()}
    assert got["with"].mae < 0.3 * plain["with"].mae
    ahead = TR.forecast_from(kept, "series", 3).orderBy("series", "step").collect()
    assert [(r.series, r.period) for r in ahead] == [(s, month(n + i)) for s, n in (("gappy", 40), ("none", 40), ("with", 60)) for i in range(3)]
    with pytest.raises(ValueError):
        TR.forecast_from(kept, "series", 0)


def test_boosters_and_their_artifacts(spark, tmp_path):
    rows = [(month(i), float(i % 12), float(i), float(2 * (i % 12) + i)) for i in range(60)]
    df = spark.createDataFrame(rows, "period date, a double, b double, y double")
    for backend in ("xgboost", "lightgbm"):
        status, model, predicted = TR.train_booster(df, "y", ["a", "b"], backend, trees=5)
        assert (status, predicted.count()) == ("ok", 12)
        TR.save_trees(spark, model, str(tmp_path / backend))
        again, gains = TR.load_trees(spark, str(tmp_path / backend))
        assert again.trees == model.trees and again.features == ["a", "b"]
        assert [r.gain for r in gains.orderBy("place").collect()] == sorted((r.gain for r in gains.collect()), reverse=True)
        assert {r.feature for r in gains.collect()} <= {"a", "b"}
    assert TR.train_booster(df, "y", ["a"], "absent")[0] == "unavailable"
    assert TR.train_booster(df.limit(9), "y", ["a"])[0] == "insufficient_data"


def test_a_hanging_trainer_is_given_up(spark):
    """One sleeps, one runs an endless job, one fails: the others finish meanwhile, and the endless job is cancelled."""
    import time

    def endless():
        slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
        return {"mae": spark.range(0, 4000, 1, 2).select(slow("id").alias("x")).agg(F.sum("x")).first()[0]}

    began = time.monotonic()
    seen = {}

    def quick():
        seen["pool"] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        return {"mae": float(spark.range(100).count()), "rmse": 1, "mape": 2}

    rows = TR.train_all(spark, {"sleeps": lambda: time.sleep(60), "endless": endless, "quick": quick, "fails": lambda: 1 / 0}, timeout=8, pool="train").collect()
    assert time.monotonic() - began < 30
    assert [(r.model_name, r.status, r.mae) for r in rows] == [("sleeps", "timeout", None), ("endless", "timeout", None), ("quick", "ok", 100.0), ("fails", "error", None)]
    assert "ZeroDivisionError" in rows[3].error and seen["pool"] == "train-quick"
    for _ in range(40):  # cancelled, not left to run for its half an hour
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_one_failing_trainer_stops_no_other(spark):
    def broken():
        raise KeyError("no such column")

    rows = TR.train_all(spark, {"arima": lambda: {"mae": 1, "rmse": 2.0, "mape": 3}, "xgboost": broken, "lightgbm": lambda: {"status": "unavailable"}}).collect()
    assert [(r.model_name, r.status, r.mae) for r in rows] == [("arima", "ok", 1.0), ("xgboost", "error", None), ("lightgbm", "unavailable", None)]
    assert "no such column" in rows[1].error


def test_forecast_dispatch(spark):
    known = {"arima": lambda n: [1.234] * n, "lstm": lambda n: [2.0] * n, "xgboost": lambda n: [1.0]}
    got = TR.forecast(spark, known, " ARIMA ", dt.date(2024, 11, 30), 3).orderBy("step").collect()
    assert [(r.model, r.step, r.period, r.predicted_value) for r in got] == [("arima", 1, dt.date(2024, 12, 1), 1.23), ("arima", 2, dt.date(2025, 1, 1), 1.23), ("arima", 3, dt.date(2025, 2, 1), 1.23)]
    assert TR.forecast(spark, known, "lstm", dt.date(2024, 1, 1), 6).count() == 6
    for name, horizon, error in (("lstm", 7, ValueError), ("arima", 0, ValueError), ("prophet", 1, ValueError), ("lightgbm", 1, LookupError), ("xgboost", 2, ValueError)):
        with pytest.raises(error):
            TR.forecast(spark, known, name, dt.date(2024, 1, 1), horizon)


def test_cleaning_job_writes_tables_and_report(spark, tmp_path):
    values = [1.0, None, 3.0, 4.0, 500.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    raw = spark.createDataFrame([(s, month(i), v) for s in ("iip", "va") for i, v in enumerate(values)], "series string, period date, value double")
    listings = spark.createDataFrame([(i, str(p), 1.0, None, None) for i, p in enumerate([1, 2, 3, 4, 900, "bad"])], "id int, price string, units_sold_est double, revenue_est double, notes string")
    checked = C.validate_codes(spark.createDataFrame([("10",), ("99",), (None,)], "code string"), spark.createDataFrame([("10",)], "code string"), "code")
    n, detail = J.run_cleaning(raw, listings, checked, str(tmp_path), passed=("va",), expected=("iip", "va", "indigo"))
    assert n == 26
    assert detail == "records=26; nan_filled=1; outliers=1; mp_outliers_flagged=1; vsic_fails=2; series_missing=indigo"
    macro = {(r.series, r.period): r for r in spark.read.parquet(str(tmp_path / "cleaned_macro")).collect()}
    assert (macro["va", month(4)].value_clean, macro["va", month(1)].fill_kind) == (500.0, "missing")
    assert macro["iip", month(1)].value_clean == 2.0
    assert macro["iip", month(4)].is_outlier
    report = json.loads(next((tmp_path / "cleaning_report").glob("part-*")).read_text())
    assert report["series_missing"] == ["indigo"]
    assert [x["series"] for x in report["macro"]] == ["iip", "va"]


def test_seeds_take_the_place_of_annual_reports(spark):
    stored = spark.createDataFrame([(1, dt.date(2022, 12, 31), "annual", 1.0, "u"), (1, dt.date(2023, 3, 31), "quarterly", 2.0, "u"), (2, dt.date(2022, 12, 31), "annual", 3.0, "u")], "company_id int, period date, report_type string, revenue double, source_url string")
    seeds = spark.createDataFrame([(1, dt.date(2024, 12, 31), 9.0), (2, None, 5.0)], "company_id int, period date, revenue double")
    got = sorted((r.company_id, str(r.period), r.revenue, r.source_url) for r in J.seed_reports(stored, seeds).collect())
    assert got == [(1, "2023-03-31", 2.0, "u"), (1, "2024-12-31", 9.0, J.SEED_SOURCE), (2, "2022-12-31", 3.0, "u")]


def test_samples_for_judging(spark):
    firms = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, name string")
    shops = spark.createDataFrame([(1, "a1"), (1, "a2"), (3, "c1")], "id int, shop string")
    got = {(r.id, r.shop, r.label) for r in J.qa_pairs(firms, shops, "id", "name", "shop").collect()}
    assert got == {(1, "a1", 1), (1, "a2", 1), (3, "c1", 1), (1, "c1", 0), (2, "c1", 0), (2, "a1", 0), (3, "a1", 0)}


def test_short_codes_open_handles(spark):
    df = spark.createDataFrame([("rd lighting", ["rangdong"]), ("rdx", ["rangdong"]), ("vnm_store", ["vinamilk"]), ("vnmilk", ["vinamilk"]), ("my rd", ["fpt"])], "shop string, b array<string>")
    assert [r.c for r in df.select(M.short_code(F.col("shop"), F.col("b")).alias("c")).collect()] == [0.72, 0.0, 0.72, 0.72, 0.0]


def test_synonyms_and_embedded_json(spark):
    df = spark.createDataFrame([("Bóng-Đèn_x", '<script id=a type="application/ld+json">\n{"a": 1}</script>'), (None, "<script>x.state = [1, 2];</script>"), ("q", '<script type="application/ld+json">{</script>')], "t string, h string")
    got = df.select(X.with_synonyms(F.col("t")).alias("t"), P.embedded_json(F.col("h")).alias("h"), P.embedded_json(F.col("h"), "state").alias("s")).collect()
    assert [r.t for r in got] == ["bong den x bong den bulb lighting", "", "q"]
    assert [(r.h, r.s) for r in got] == [('{"a": 1}', None), (None, "[1, 2]"), (None, None)]


def test_macro_comes_from_the_artifact_or_the_table(spark, tmp_path):
    from loomwork.operators import features as FT

    rows = spark.createDataFrame([("IIP", month(0).replace(day=15), 1.0), ("IIP", month(1), None), ("IIP", month(2), 3.0), ("PEER", month(1), None), ("PEER", month(2), 7.0), ("BCI", month(2), 9.0)], "code string, period date, value double")
    series = {"iip": F.col("code") == "IIP", "peer": F.col("code") == "PEER", "mei_bci": F.col("code") == "BCI"}
    load = lambda path: sorted(map(tuple, FT.load_macro(spark, str(path), rows, series).select("period", "iip", "peer", "source").collect()))
    table = [(month(0), 1.0, None, "table"), (month(1), 2.0, None, "table"), (month(2), 3.0, 7.0, "table")]  # the target alone is filled
    assert load(tmp_path / "none") == table
    good = spark.createDataFrame([(month(5).replace(day=9), 5.0, 6.0, 1.0)], "period date, iip double, peer double, mei_bci double")
    good.where("false").write.parquet(str(tmp_path / "empty"))
    good.drop("iip").write.parquet(str(tmp_path / "partial"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.parquet").write_text("not parquet")
    assert [load(tmp_path / n) for n in ("empty", "partial", "broken")] == [table] * 3
    good.write.parquet(str(tmp_path / "good"))
    assert load(tmp_path / "good") == [(month(5), 5.0, 6.0, "artifact")]
    assert "mei_bci" not in FT.load_macro(spark, str(tmp_path / "good"), rows, series).columns


def test_reports_of_benchmarks(spark):
    from loomwork.operators.narrative import benchmark_report

    rows = [(1, "roa", 0.5, 0.4, 5, "above_average", 90.0), (1, "roe", 0.1, 0.2, 5, "below_average", 20.0), (1, "debt", None, 0.3, 5, None, None), (2, "roa", 0.5, None, 0, None, None), (3, "roa", 0.25, 0.25, 4, "average", 50.0), (3, "roe", 0.3, 0.2, 4, "above_average", None)]
    got = {r.id: r for r in benchmark_report(spark.createDataFrame(rows, "id int, metric string, value double, average double, peers int, label string, percentile double"), "id").collect()}
    assert (got[1].strongest, got[1].weakest, got[1].omitted) == ("roa", "roe", ["debt"])
    assert got[1].text == "Strongest is roa: 0.5000, percentile 90.0, above the average of 0.4000. Weakest is roe: 0.1000, percentile 20.0, below the average of 0.2000. No figures for debt."
    assert [(c.field, c.value) for c in got[1].citations] == [("roa", 0.5), ("roa.percentile", 90.0), ("roa.average", 0.4), ("roe", 0.1), ("roe.percentile", 20.0), ("roe.average", 0.2)]
    assert (got[2].strongest, got[2].text, got[2].citations) == (None, "No percentile is known. No figures for roa.", [])
    assert (got[3].strongest, got[3].weakest, len(got[3].citations)) == ("roa", None, 3)
