import pytest

from loomwork.operators import evaluation as E
from loomwork.operators import tables as T
from loomwork.sources import writers


def test_upsert_overwrites_with_null_but_for_kept_fields(spark):
    old = spark.createDataFrame([(1, "a", "u1"), (2, "b", "u2")], "id int, v string, url string")
    new = spark.createDataFrame([(2, None, None), (3, "c", None)], "id int, v string, url string")
    rows = {r.id: (r.v, r.url, r._change) for r in T.upsert(old, new, ["id"], ("url",)).collect()}
    assert rows == {1: ("a", "u1", "kept"), 2: (None, "u2", "updated"), 3: ("c", None, "inserted")}


def test_last_wins(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "id int, seq int, v string")
    assert [tuple(r) for r in T.last_wins(rows, ["id"], "seq").collect()] == [(1, 2, None)]


def test_cascade(spark):
    empty = spark.createDataFrame([], "k int, v int")
    a, b = spark.createDataFrame([(1, 1)], "k int, v int"), spark.createDataFrame([(1, 9), (2, 2)], "k int, v int")
    assert {(r.k, r.v, r.source_tier, r.status) for r in T.cascade([("live", empty), ("seed", a), ("file", b)], ["k"]).collect()} == {(1, 1, "seed", "fallback"), (2, 2, "file", "fallback")}


def test_errors(spark):
    r = E.errors(spark.createDataFrame([("a", 10.0, 12.0), ("a", 20.0, 18.0), ("a", 30.0, 33.0), ("z", 0.0, 1.0)], "k string, y double, p double"), ["k"], "y", "p").collect()
    by = {x.k: x for x in r}
    assert by["a"].mae == pytest.approx(7 / 3, abs=1e-4)
    assert by["a"].rmse == pytest.approx((17 / 3) ** 0.5, abs=1e-4)
    assert by["z"].mape == 0.0


def test_confusion_without_positives(spark):
    r = spark.createDataFrame([(False, False)], "t boolean, g boolean")
    from pyspark.sql import functions as F

    assert r.agg(*E.confusion(F.col("t"), F.col("g"))).first().f1 == 0.0


def test_empty_families_are_listed(spark):
    jobs = spark.createDataFrame([(1, "gso", "success", "2024-01-01")], "id int, job_name string, status string, created_at string")
    got = {r.family: r.status for r in T.latest_jobs(jobs, T.FAMILIES).collect()}
    assert got["gso"] == "success"
    assert set(got) == set(T.FAMILIES)
    assert got["oecd"] is None


def test_log_refuses_secrets(spark, tmp_path):
    good = spark.createDataFrame([("revenue", "1")], "field string, after string")
    writers.append_log(good, str(tmp_path / "log"))
    with pytest.raises(ValueError):
        writers.append_log(spark.createDataFrame([("x", "api_key=1")], "field string, after string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_empty_baseline_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, None)], "id int, model_name string, trained_at int, mape double")
    with pytest.raises(ValueError):
        writers.write_baseline(rows, str(tmp_path / "b"))
