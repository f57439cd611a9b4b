"""Copy-on-write tables: which buckets a batch rewrites, replays, crashes, conflicts, lookups."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators.keyed_tables import Conflict, KeyedTable

SCHEMA = "k long, part string, v string, seq int"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("part"), F.lit("old").alias("v"), F.lit(0).alias("seq"))
    t = KeyedTable(spark, str(tmp_path / "t")).create(rows.schema, ["k", "part"], buckets=16)
    assert t.merge(rows) == {"inserted": 400, "updated": 0, "kept": 0, "buckets": 16}
    return t


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def test_a_batch_rewrites_its_buckets_alone(spark, table):
    before = table.manifest()
    got = table.merge(batch(spark, [(7, "1", "a", 1), (7, "1", "b", 2), (8, "2", None, 1), (999, "x", "new", 1)]), "seq", ("v",))
    after = table.manifest()
    changed = {b for b in after.files if after.files[b] != before.files.get(b)}
    assert len(changed) == got["buckets"] <= 3 and (got["inserted"], got["updated"]) == (1, 2)
    assert sum(f["rows"] for f in after.files.values()) == 401
    rows = {(r.k, r.part): r.v for r in table.read().collect()}
    assert (rows[7, "1"], rows[8, "2"], rows[999, "x"], rows[9, "0"]) == ("b", "old", "new", "old")
    assert {r.v for r in table.read(before.version).collect()} == {"old"}  # readers of the state before


def test_replays_change_nothing(spark, table):
    one, two = batch(spark, [(1, "1", "one", 1)]), batch(spark, [(1, "1", "two", 2)])
    table.merge(one, "seq", writer="w", number=0)
    table.merge(two, "seq", writer="w", number=1)
    version, rows = table.manifest().version, state(table)
    for df, n in ((one, 0), (two, 1)):
        assert table.merge(df, "seq", writer="w", number=n)["buckets"] == 0
    assert (table.manifest().version, state(table)) == (version, rows)
    table.merge(one, "seq", writer="other", number=0)  # another writer's first batch counts
    assert table.manifest().version == version + 1


def test_a_crash_before_the_swap_changes_nothing(spark, table):
    version, rows = table.manifest().version, state(table)

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        table.merge(batch(spark, [(1, "1", "half", 1)]), "seq", writer="w", number=0, before_swap=crash)
    assert (table.manifest().version, state(table)) == (version, rows)
    assert table.merge(batch(spark, [(1, "1", "whole", 1)]), "seq", writer="w", number=0)["updated"] == 1
    assert table.vacuum() >= 1  # what the crash left
    assert ("whole" in {r.v for r in table.read().collect()}) and table.versions() == [version + 1]


def test_only_one_of_two_writers_wins(spark, table):
    def another():
        KeyedTable(spark, table.path).merge(batch(spark, [(2, "2", "first", 1)]), "seq")

    with pytest.raises(Conflict):
        table.merge(batch(spark, [(2, "2", "second", 1)]), "seq", before_swap=another)
    assert table.lookup(batch(spark, [(2, "2", None, 0)])).first().v == "first"


def test_lookup_reads_few_files(spark, table):
    found = table.lookup(batch(spark, [(5, "2", None, 0), (5, "0", None, 0), (12345, "z", None, 0)]))
    assert [tuple(r) for r in found.collect()] == [(5, "2", "old", 0)]
    assert len(found.inputFiles()) <= 3


def test_odd_batches(spark, table):
    n = table.manifest().version
    assert table.merge(batch(spark, []), "seq")["buckets"] == 0 and table.manifest().version == n
    got = table.merge(spark.createDataFrame([(None, None, 1.5, "extra"), (401, "0", 2.5, "extra")], "k long, part string, bucket double, _change string"))
    assert got["inserted"] == 2
    table.merge(batch(spark, [(None, None, "again", 1)]), "seq")
    assert [r.v for r in table.read().where("k IS NULL").collect()] == ["again"]
    assert table.lookup(batch(spark, [(None, None, None, 0)])).count() == 1
    with pytest.raises(LookupError):
        KeyedTable(spark, table.path + "-none").read()
    with pytest.raises(Conflict):
        table.create(table.manifest().schema, ["k"])
