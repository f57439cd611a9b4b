import bisect
import datetime as dt
import itertools
import math
import random
import statistics

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwork.operators import benchmark as B
from loomwork.operators import metrics as M
from loomwork.plans import firms, series


def test_ratios_are_null_safe(spark):
    r = M.benchmark_ratios(spark.createDataFrame([(10.0, 0.0, 4.0)], "profit_before_tax double, total_assets double, total_equity double")).first()
    assert r.roa is None
    assert r.roe == 2.5
    assert r.debt_to_equity == -1.0
    assert r.current_ratio is None


def test_online_revenue_and_adoption(spark):
    listings = spark.createDataFrame([(1, "shopee", 45000.0, 12500, None), (1, "Shopee", 285000.0, 3200, None), (1, "website", 1.0, 10**6, None)], "company_id int, platform string, price double, units_sold_est int, revenue_est double")
    firms = spark.createDataFrame([(1, 5.2e12), (2, 162e12), (3, None)], "company_id int, revenue double")
    got = {r.company_id: (r.online_revenue, r.basis) for r in M.online_revenue(listings, firms).collect()}
    assert got == {1: (1_474_500_000.0, "listings"), 2: (0.0, "missing"), 3: (0.0, "missing")}
    assert {r.company_id: r.online_revenue for r in M.online_revenue(listings, firms, 0.02).collect()}[2] == pytest.approx(162e12 * 0.02)
    presence = spark.createDataFrame([(1, "website", True, None), (1, "shopee", True, 0.95), (1, "tiktok", True, 0.5), (2, "website", False, None)], "company_id int, channel_type string, is_active boolean, match_confidence double")
    f = spark.createDataFrame([(1, True), (2, None)], "company_id int, has_ecommerce_site boolean")
    assert {r.company_id: (r.adoption, r.diversity) for r in M.adoption(presence, f).collect()} == {1: (0.75, 0.5), 2: (0.0, 0.0)}


def test_industry_share(spark):
    rows = spark.createDataFrame([("2740", 100.0), ("2710", 300.0), ("1050", 50.0), ("3290", 0.0)], "code string, va double")
    assert {r.code: r.industry_share_pct for r in M.industry_share(rows, "code", "va").collect()} == {"2740": 25.0, "2710": 75.0, "1050": 100.0, "3290": 0.0}


def report(i, group, roe):
    return (i, group, dt.date(2024, 12, 31), "annual", roe, 1.0)


REPORT = "company_id int, g string, period date, report_type string, profit_before_tax double, total_equity double"


def test_small_samples_have_no_quartiles(spark):
    peers = spark.createDataFrame([report(1, "27", 0.1), report(2, "27", 0.3)], REPORT)
    target = spark.createDataFrame([report(9, "27", 0.3), report(8, "32", 0.2)], REPORT)
    rows = {(r.company_id, r.metric): r for r in B.compare(target, peers, "g", metrics=("roe",)).collect()}
    assert rows[9, "roe"].peers == 2
    assert rows[9, "roe"].p50 is None
    assert rows[9, "roe"].percentile == 100.0
    assert rows[9, "roe"].label == "above_average"
    assert rows[9, "roe"].warnings == ["prototype_listed_sample", "small_peer_sample"]
    assert (rows[8, "roe"].peers, rows[8, "roe"].percentile, rows[8, "roe"].label) == (0, None, "insufficient_peers")


def test_quartiles_are_inclusive(spark):
    peers = spark.createDataFrame([report(i, "22", v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0])], REPORT)
    r = B.statistics(B.long_ratios(peers, ["company_id", "g"], ("roe",)), ["g", "metric"]).first()
    assert (r.p25, r.p50, r.p75) == (1.75, 2.5, 4.75)


def test_latest_report_prefers_annual(spark):
    rows = spark.createDataFrame([(1, "quarterly", dt.date(2024, 9, 30)), (1, "annual", dt.date(2023, 12, 31)), (2, None, dt.date(2024, 1, 1))], "company_id int, report_type string, period date")
    assert {r.company_id: r.report_type for r in B.latest_reports(rows).collect()} == {1: "annual", 2: None}


def test_peers_without_self(spark):
    peers = spark.createDataFrame([report(1, "a", 1.0), report(2, "a", 3.0), report(3, "b", 5.0)], REPORT)
    rows = {r.company_id: r for r in B.compare(peers, peers, "g", metrics=("roe",), exclude_self=True).collect()}
    assert (rows[1].peers, rows[1].average, rows[1].percentile, rows[1].label) == (1, 3.0, 0.0, "below_average")
    assert (rows[3].peers, rows[3].average, rows[3].label) == (0, None, "insufficient_peers")


def test_consistency(spark):
    got = spark.createDataFrame([(1, 109.0, 5.0, 10.0, None, 0)], "id int, operating_revenue double, profit_before_tax double, total_assets double, total_equity double, employees int")
    stored = spark.createDataFrame([(1, 100.0, 0.0, 20.0, 1.0, 0)], "id int, revenue double, profit_before_tax double, total_assets double, total_equity double, employees int")
    assert {r.field: (r.severity, r.note) for r in B.consistency(got, stored, "id").collect()} == {
        "operating_revenue": ("ok", None), "profit_before_tax": ("mismatch", "zero_db"), "total_assets": ("mismatch", None), "total_equity": ("warn", "missing"), "employees": ("ok", None),
    }


def test_places_of_values_are_exact(spark):
    import random

    from loomwork.operators import benchmark as B

    rng = random.Random(2)
    rows = [(g, float(rng.choice([rng.randint(0, 9), rng.gauss(0, 50)]))) for g in "aab" for _ in range(400)] + [("one", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    by = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", "b", "one")}
    for ranges in (2, 64):
        got = B.placed_values(df, ["g"], ranges=ranges).collect()
        assert {(r.g, r.value): (r.n, r.le, r.total) for r in got} == {(g, x): (v.count(x), sum(y <= x for y in v), len(v)) for g, v in by.items() for x in v}
        assert len(got) == sum(len(set(v)) for v in by.values())


def test_places_of_many_different_values_are_exact(spark):
    """So many groups and values that their approximate quantiles depend on the order in which parts of a group meet."""
    groups, each = 200, 1000
    value = lambda i: i * 48271 % 2147483647
    by = {g: sorted(float(value(i)) for i in range(g, groups * each, groups)) for g in range(groups)}
    population = spark.range(0, groups * each, 1, 7).select((F.col("id") % groups).alias("g"), value(F.col("id")).cast("double").alias("value"))
    places = B.placed_values(population, ["g"]).collect()
    assert len(places) == groups * each
    assert sum((r.n, r.le, r.total) != (1, bisect.bisect_right(by[r.g], r.value), each) for r in places) == 0
    quartiles = {r.g: (r.p25, r.p50, r.p75) for r in B.statistics(population, ["g"]).collect()}
    assert quartiles == {g: tuple(pytest.approx(q, abs=1e-6) for q in statistics.quantiles(v, method="inclusive")) for g, v in by.items()}


@pytest.fixture(scope="module")
def tied_lines(tmp_path_factory):
    """Tables of 24 firms with a line each, whose profits, taxes and costs end in half a cent."""
    folder = tmp_path_factory.mktemp("tied")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS s_suppkey, 'Supplier' AS s_name, CAST(i % 2 AS INTEGER) AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(1, 25) AS r(i)) TO '{folder}/supplier.parquet'")
    c.execute(
        f"""COPY (SELECT i AS l_orderkey, i AS l_partkey, i AS l_suppkey, CAST(1 AS INTEGER) AS l_linenumber, CAST(1 + i % 5 AS DOUBLE) AS l_quantity, 100.5 + i * 37.0::DOUBLE AS l_extendedprice, 0.01::DOUBLE AS l_discount, 0.03::DOUBLE AS l_tax,
        'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1997-03-04' AS l_shipdate FROM range(1, 25) AS r(i)) TO '{folder}/lineitem.parquet'"""
    )
    return folder


def equals_its_sql(spark, folder, name):
    """Whether a query gives its SQL's rows, bit by bit."""
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    return order(entry.queries()[name](spark, str(folder)).select(*names).collect()) == order(found.fetchall())


def test_half_cents_round_as_in_sql(spark):
    rows = spark.createDataFrame([(v,) for v in (1.005, 2.675, -1.005, 0.5, 12.345, None)], "v double").select(M.rounded(F.col("v"), 2).alias("r"))
    assert [r.r for r in rows.collect()] == [x[0] for x in duckdb.sql("SELECT round(v, 2) FROM (SELECT unnest([1.005, 2.675, -1.005, 0.5, 12.345, NULL]::DOUBLE[]) AS v)").fetchall()]


@pytest.mark.parametrize("name", ["benchmark_full", "benchmark_reports", "peer_percentile", "peer_quartiles"])
def test_benchmarks_of_half_cents(spark, tied_lines, name):
    assert equals_its_sql(spark, tied_lines, name)


@pytest.fixture(scope="module")
def lines_in_row_groups(tmp_path_factory):
    """Tables whose 6 row groups of 9 MB are larger than a piece; a firm's lines, whose profits sum to half a cent, lie in two that follow each other.

    Two firms share their lines, of which the one has 20 in the first row group, the other 60. And the profits, summed by row group.
    """
    folder, rng = tmp_path_factory.mktemp("groups"), random.Random(7)
    groups, profits = [[] for _ in range(6)], {}
    for pair in range(100):
        k = pair % 5
        lines = [(rng.randrange(90_000, 9_999_999), rng.randrange(11)) for _ in range(80)]
        units = sum(p * d for p, d in lines)
        lines[-1] = (lines[-1][0] + (50 - units + lines[-1][0] * lines[-1][1] - lines[-1][0]) % 100, 1)  # their sum is half a cent
        for firm, cut in ((2 * pair, 20), (2 * pair + 1, 60)):
            parts = [[(p / 100, d / 100) for p, d in part] for part in (lines[:cut], lines[cut:])]
            for i, part in enumerate(parts):
                groups[k + i] += [(firm, p, d) for p, d in part]
            profits[firm] = math.floor(sum(sum_in_order(p * d for p, d in part) for part in parts) * 100 + 0.5) / 100
    schema = pa.schema({"l_suppkey": pa.int64(), "l_quantity": pa.float64(), "l_extendedprice": pa.float64(), "l_discount": pa.float64(), "l_tax": pa.float64(), "l_shipdate": pa.timestamp("us"), "padding": pa.string()})
    with pq.ParquetWriter(folder / "lineitem.parquet", schema, compression="none", use_dictionary=False) as out:
        for rows in groups:
            padding = "x" * (9_000_000 // len(rows))
            out.write_table(pa.Table.from_pylist([{"l_suppkey": f, "l_quantity": 1.0, "l_extendedprice": p, "l_discount": d, "l_tax": 0.0, "l_shipdate": dt.datetime(1997, 3, 4), "padding": padding} for f, p, d in rows], schema=schema))
    pq.write_table(pa.table({"s_suppkey": pa.array(range(200), pa.int64()), "s_nationkey": pa.array([i // 2 % 5 for i in range(200)], pa.int32())}), folder / "supplier.parquet")
    return folder, profits


def sum_in_order(values):
    """The sum of doubles, one after the other (Python's own sum mends their errors)."""
    total = 0.0
    for v in values:
        total += v
    return total


def test_sums_are_those_of_row_groups(spark, lines_in_row_groups):
    folder, profits = lines_in_row_groups
    got = {r.company_id: r.profit_before_tax for r in firms.reports(spark, str(folder)).select("company_id", "profit_before_tax").collect()}
    assert got == profits


def test_pieces_leave_the_settings_of_the_session(spark, tied_lines):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        own = series.read_in_pieces(spark, str(tied_lines), "lineitem").sparkSession
        assert own.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert firms.reports(spark, str(tied_lines)).sparkSession is spark


def by_group(profits):
    """Profits of a worker (a line) by group code."""
    return {f"0{g}": sorted(p / 80 for firm, p in profits.items() if firm // 2 % 5 == g) for g in range(5)}


def test_percentiles_over_sums_of_row_groups(spark, lines_in_row_groups):
    folder, profits = lines_in_row_groups
    got = {r.company_id: r.percentile for r in firms.peer_percentile(spark, str(folder)).where("metric = 'profit_per_worker'").collect()}
    peers = by_group(profits)
    assert got == {firm: bisect.bisect_right(peers[f"0{firm // 2 % 5}"], p / 80) * 2.5 for firm, p in profits.items()}


def test_quartiles_over_sums_of_row_groups(spark, lines_in_row_groups):
    folder, profits = lines_in_row_groups
    got = {r.group_code: (r.p25, r.p50, r.p75) for r in firms.peer_quartiles(spark, str(folder)).where("metric = 'profit_per_worker'").collect()}
    assert got == {g: tuple(pytest.approx(q, abs=1e-6) for q in statistics.quantiles(v, method="inclusive")) for g, v in by_group(profits).items()}


@pytest.fixture(scope="module")
def lines_in_files(tmp_path_factory):
    """Tables whose lines lie in four files of 1, 9, 3 and 6 MB; a firm's lines, whose profits sum to half a cent, lie in all four.

    Two firms share their lines, cut at other places. And the profits, summed by file and added in the order of the files' names.
    """
    folder, rng = tmp_path_factory.mktemp("files"), random.Random(11)
    files, profits = [[] for _ in range(4)], {}
    for pair in range(100):
        lines = [(rng.randrange(90_000, 9_999_999), rng.randrange(11)) for _ in range(80)]
        units = sum(p * d for p, d in lines)
        lines[-1] = (lines[-1][0] + (50 - units + lines[-1][0] * lines[-1][1] - lines[-1][0]) % 100, 1)  # their sum is half a cent
        for firm, cuts in ((2 * pair, (0, 20, 40, 60, 80)), (2 * pair + 1, (0, 10, 30, 70, 80))):
            parts = [[(p / 100, d / 100) for p, d in lines[a:z]] for a, z in itertools.pairwise(cuts)]
            for rows, part in zip(files, parts, strict=True):
                rows += [(firm, p, d) for p, d in part]
            profits[firm] = math.floor(sum_in_order(sum_in_order(p * d for p, d in part) for part in parts) * 100 + 0.5) / 100
    schema = pa.schema({"l_suppkey": pa.int64(), "l_quantity": pa.float64(), "l_extendedprice": pa.float64(), "l_discount": pa.float64(), "l_tax": pa.float64(), "l_shipdate": pa.timestamp("us"), "padding": pa.string()})
    (folder / "lineitem.parquet").mkdir()
    for i, (rows, size) in enumerate(zip(files, (1, 9, 3, 6), strict=True)):
        padding = "x" * (size * 1_000_000 // len(rows))
        table = pa.Table.from_pylist([{"l_suppkey": f, "l_quantity": 1.0, "l_extendedprice": p, "l_discount": d, "l_tax": 0.0, "l_shipdate": dt.datetime(1997, 3, 4), "padding": padding} for f, p, d in rows], schema=schema)
        pq.write_table(table, folder / f"lineitem.parquet/part-{i}.parquet", compression="none", use_dictionary=False)
    pq.write_table(pa.table({"s_suppkey": pa.array(range(200), pa.int64()), "s_nationkey": pa.array([i // 2 % 5 for i in range(200)], pa.int32())}), folder / "supplier.parquet")
    return folder, profits


def test_percentiles_over_sums_added_in_order_of_files(spark, lines_in_files):
    folder, profits = lines_in_files
    got = {r.company_id: r.percentile for r in firms.peer_percentile(spark, str(folder)).where("metric = 'profit_per_worker'").collect()}
    peers = by_group(profits)
    assert got == {firm: bisect.bisect_right(peers[f"0{firm // 2 % 5}"], p / 80) * 2.5 for firm, p in profits.items()}


def test_pieces_do_not_depend_on_cores(spark, lines_in_files):
    folder, _ = lines_in_files
    tasks = lambda: series.read_in_pieces(spark, str(folder), "lineitem").rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.minPartitionNum", 64)  # what 64 cores set
    try:
        many = tasks()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert many == tasks()


def test_quartiles_over_sums_added_in_order_of_files(spark, lines_in_files):
    folder, profits = lines_in_files
    got = {r.group_code: (r.p25, r.p50, r.p75) for r in firms.peer_quartiles(spark, str(folder)).where("metric = 'profit_per_worker'").collect()}
    assert got == {g: tuple(pytest.approx(q, abs=1e-6) for q in statistics.quantiles(v, method="inclusive")) for g, v in by_group(profits).items()}
