"""Queries over streams, SQL functions, narratives, and general relational forms."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions.register import register_functions
from ..operators import narrative as N
from ..operators import windows as W
from ..streaming import feedback as S
from . import firms
from .series import monthly, quarterly, read

NAMES = iter(range(1 << 30))


def _folder(spark) -> str:
    """A place for a stream's progress and result: the cluster's shared folder, and one of our own under a local master alone."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/stream-{next(NAMES)}-{spark.sparkContext.applicationId}" if shared else tempfile.mkdtemp(prefix="loomwork-stream-")


def stream_event_counts(spark, sf_dir):
    """Events as a stream of files, counted by type over all that has landed."""
    schema = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream reads no single file
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 1).alias("total"))
    folder = _folder(spark)
    S.run_available(counts, f"{folder}/result", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/result")


def sql_functions(spark, sf_dir):
    register_functions(spark)
    read(spark, sf_dir, "supplier").createOrReplaceTempView("loomwork_supplier")
    return spark.sql("SELECT s_suppkey, round(safe_ratio(s_acctbal, CAST(s_nationkey AS DOUBLE)), 6) AS per_nation, vsic_division(s_name) AS division, quarter_end(2000 + s_nationkey, 1 + s_nationkey % 4) AS q FROM loomwork_supplier")


def sql_step_hold(spark, sf_dir):
    """The value of each quarter of each order priority on its three months, by a table function on the quarters' rows."""
    register_functions(spark)
    quarterly(spark, sf_dir).createOrReplaceTempView("loomwork_quarters")
    return spark.sql("SELECT q.series, t.month, q.value FROM loomwork_quarters q, LATERAL step_hold(q.period, 3) t")


def benchmark_narrative(spark, sf_dir):
    rows = N.benchmark_sentences(firms.benchmark_full(spark, sf_dir), "company_id")
    return rows.select("company_id", F.length("text").alias("n_chars"), F.array_join("left_out", ",").alias("left_out"), "honest")


def forecast_narrative(spark, sf_dir):
    """Each month of each series against the one before, in words."""
    rows = W.lags(monthly(spark, sf_dir), ["series"], "value", (1,)).withColumn("name", F.concat_ws(" ", "series", F.date_format("period", "yyyy-MM")))
    return N.forecast_sentences(rows, "name", "value_lag1", "value")


def universe_coverage(spark, sf_dir):
    return N.coverage_note(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def revenue_rollup(spark, sf_dir):
    """Orders by status and priority with subtotals."""
    return read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


def top_parts_by_brand(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return W.latest(p, ["p_brand"], F.desc("p_retailprice"), F.asc("p_partkey"))


def customers_without_orders(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


QUERIES = {f.__name__: f for f in (stream_event_counts, sql_functions, sql_step_hold, benchmark_narrative, forecast_narrative, universe_coverage, revenue_rollup, top_parts_by_brand, customers_without_orders)}
SQL = {
    "stream_event_counts": "SELECT event_type, count(*) AS n, round(sum(value), 1) AS total FROM events GROUP BY 1",
    "sql_functions": "SELECT s_suppkey, round(s_acctbal / nullif(s_nationkey, 0), 6) AS per_nation, substr(s_name, 1, 2) AS division, last_day(make_date(2000 + s_nationkey, (1 + s_nationkey % 4) * 3, 1)) AS q FROM supplier",
    "sql_step_hold": """WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
 q AS (SELECT series, CAST(date_trunc('quarter', period) AS DATE) AS q, round(sum(value), 2) AS value FROM m GROUP BY 1, 2) SELECT series, CAST(q + to_months(CAST(i AS INTEGER)) AS DATE) AS month, value FROM q, range(3) AS r(i)""",
    "forecast_narrative": """WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY period) AS p FROM m),
 d AS (SELECT series || ' ' || strftime(period, '%Y-%m') AS name, round((value - p) / nullif(abs(p), 0) * 100, 2) AS d FROM l)
 SELECT name, d AS delta_pct, name || ' ' || CASE WHEN d IS NULL THEN NULL WHEN d > 0 THEN 'rises by ' || abs(d) || ' %' WHEN d < 0 THEN 'falls by ' || abs(d) || ' %' ELSE 'stays' END AS text FROM d""",
    "universe_coverage": "SELECT count(*) AS n_universe, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_deep, CASE WHEN (SELECT count(DISTINCT o_custkey) FROM orders) < count(*) THEN 'prototype_sample' ELSE 'full' END AS label FROM customer",
    "revenue_rollup": "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "top_parts_by_brand": "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1",
    "customers_without_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}
