"""Kept observations over restarts and expiry."""

import datetime as dt

import pytest

from loomwork.streaming import state as S

SCHEMA = "key string, at timestamp, value double, ok boolean, seed double"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def stream(spark, tmp_path):
    """A function that lands rows and lets a new query of the same checkpoint take them."""
    landed, out, progress = (str(tmp_path / n) for n in ("landed", "out", "progress"))

    def take(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        S.run_to_files(S.keep_previous(spark.readStream.schema(SCHEMA).parquet(landed), "10 days", "0 days"), out, progress)
        return {tuple(r) for r in spark.read.schema(S.OUTPUT).parquet(out).collect()}

    take.progress = progress
    return take


def kept(spark, stream):
    return {(r.key, r.value, r.at) for r in S.kept_values(spark, stream.progress).collect()}


def test_keeping_over_restarts_and_expiry(spark, stream):
    first = stream([("a", day(0), 1.0, True, None), ("a", day(1), None, False, None), ("b", day(0), None, False, 7.0), ("c", day(1), None, None, None), ("a", day(1), 2.0, True, None)])
    assert first >= {("a", day(0), 1.0, "fresh"), ("a", day(1), 1.0, "kept"), ("a", day(1), 2.0, "fresh"), ("b", day(0), 7.0, "seed"), ("c", day(1), None, "none")}
    assert kept(spark, stream) == {("a", 2.0, day(1))}
    # a new query goes on from the checkpoint: nothing comes twice, the value is still there
    second = stream([("a", day(3), None, False, 9.0), ("b", day(3), 5.0, True, None)])
    assert second - first == {("a", day(3), 2.0, "kept"), ("b", day(3), 5.0, "fresh")}
    assert kept(spark, stream) == {("a", 2.0, day(1)), ("b", 5.0, day(3))}
    # event time passes a's value by ten days, b's is renewed
    third = stream([("b", day(12), 6.0, True, None)])
    fourth = stream([("a", day(13), None, False, 9.0), ("c", day(13), None, False, None)])
    assert ("a", day(11), None, "expired") in fourth - second
    assert ("a", day(13), 9.0, "seed") in fourth - third
    assert kept(spark, stream) == {("b", 6.0, day(12))}


def test_late_and_odd_rows(spark, stream):
    got = stream([("a", day(5), 5.0, True, None), (None, day(5), 1.0, True, None), ("a", None, 1.0, True, None), ("n", day(5), None, True, None)])
    assert len(got) == 3
    assert kept(spark, stream) == {("a", 5.0, day(5)), (None, 1.0, day(5)), ("n", None, day(5))}
