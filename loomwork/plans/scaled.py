"""Queries over one long series, over state and tables that persist, and over landed files as a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.walk_forward import register_walk_forward
from ..operators import features as FT
from ..operators import forest as FO
from ..operators import narrative as N
from ..operators import recurrent as RN
from ..operators import segmented as SG
from ..operators import tables as T
from ..operators import windows as W
from ..operators.evaluation import fold_means
from ..operators.keyed_tables import KeyedTable
from ..operators.shared import new_folder
from ..sources import landed
from ..sources import payloads as P
from ..streaming import state as ST
from . import firms
from .series import MONTHLY, QUARTERLY, daily, monthly, quarterly, read

#: Rows of a segment: small enough that test tables lie in several.
SEGMENT = 2_000


def long_series(spark, sf_dir):
    """All events as one series with gaps of one to four rows, and one of eleven in each 500."""
    gone = (F.col("event_id") % 13 < 4) & (F.col("event_id") % 3 > 0) | (F.col("event_id") % 500).between(200, 210)
    return read(spark, sf_dir, "events").select("event_id", F.when(~gone, F.col("value")).alias("value"))


def segmented_features(spark, sf_dir):
    """Lags, trailing means, growth and filled gaps of all events as one series in many segments."""
    s = SG.Segmented(long_series(spark, sf_dir), [], "event_id", SEGMENT).lags("value", (1, 3)).rolling_means("value", (3,)).growth("value", "growth").gaps_filled("value", max_gap=3)
    return s.df.select("event_id", "value_lag1", "value_lag3", F.round("value_roll3m", 6).alias("value_roll3m"), F.round("growth", 6).alias("growth"), "gap_rows", F.round("value_filled", 6).alias("value_filled"), "fill_kind")


def segmented_asof(spark, sf_dir):
    """Each event with the last purchase at or before it, over all users."""
    e = read(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").groupBy("ts").agg(F.max("event_id").alias("purchase_id"), F.max("value").alias("purchase_value"))
    return SG.asof_backward(e.select("event_id", "ts"), bought, [], ["purchase_id", "purchase_value"], "ts", SEGMENT).select("event_id", "purchase_id", "purchase_value")


def kept_observations(spark, sf_dir):
    """All events as a stream of observations, those of type error having failed: what the state keeps for each user in the end."""
    e = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("value"), (F.col("event_type") != "error").alias("ok"), F.lit(None).cast("double").alias("seed"))
    folder = new_folder(spark, "kept")
    ST.run_to_files(ST.keep_previous(rows, "36500 days", "0 days"), f"{folder}/rows", f"{folder}/progress")
    return ST.kept_values(spark, f"{folder}/progress").withColumn("at", F.col("at").cast("timestamp_ntz"))


def keyed_table_merges(spark, sf_dir):
    """A table of users and event types after two merged batches of all events, with the buckets that the second has rewritten."""
    columns = ["user_id", "event_type", "event_id", "value"]
    e = read(spark, sf_dir, "events").select(*columns)
    table = KeyedTable(spark, new_folder(spark, "keyed")).create(e.schema, ["user_id", "event_type"], buckets=32)
    table.merge(e.where("event_id % 2 = 0"), "event_id", writer="events", number=0)
    late = e.where("event_id % 2 = 1").withColumn("value", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    for number in (1, 1):  # the batch comes twice
        table.merge(late, "event_id", ("value",), writer="events", number=number)
    return table.read()


def landed_lines(spark, sf_dir):
    """All events as landed lines in a folder for each type, each fiftieth line cut off: rows and sums by type and reason, as the source reads them."""
    folder = new_folder(spark, "landed")
    e = read(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    cut = F.when(F.col("event_id") % 50 == 0, F.expr("substring(line, 1, length(line) - 1)")).when(F.col("event_id") % 77 == 0, F.lit('{"event_id": "none"}')).otherwise(F.col("line"))
    e.select(F.col("event_type").alias("type"), F.col("event_id"), line.alias("line")).select("type", cut.alias("value")).write.partitionBy("type").text(folder)
    landed.register(spark)
    schema = f"type string, event_id bigint, user_id bigint, value double, {landed.ORIGIN}"
    rows = spark.read.format("landed").option("kind", "jsonl").option("split_bytes", 1 << 20).schema(schema).load(folder)
    by_type = rows.withColumn("type", F.regexp_extract("_file", "type=([^/]*)/", 1))
    return by_type.groupBy("type", F.col("_bad").alias("reason")).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


def forest_anomalies(spark, sf_dir):
    """Days of all event types scored by one isolation forest."""
    return FO.anomalies(daily(spark, sf_dir), "series")


def recurrent_forecast(spark, sf_dir):
    """Six months ahead of each order priority by one recurrent net over all of them."""
    return RN.forecast(monthly(spark, sf_dir), "series")


def walk_forward_sql(spark, sf_dir):
    """Fold errors of the last value held, by a table function over each order priority's months."""
    register_walk_forward(spark, "naive_folds", lambda values, horizon: [values[-1]] * horizon)
    monthly(spark, sf_dir).createOrReplaceTempView("loomwork_monthly")
    folds = spark.sql("SELECT * FROM naive_folds(TABLE(loomwork_monthly) PARTITION BY series ORDER BY period, key => 'series', period => 'period', value => 'value', min_train => 24, test_size => 6, step => 6)")
    return fold_means(folds.withColumnRenamed("key", "series"), ["series"], "actual", "predicted")


def benchmark_reports(spark, sf_dir):
    """What a benchmark says of each firm: its strongest and weakest metric, figures cited, metrics omitted."""
    rows = N.benchmark_report(firms.benchmark_full(spark, sf_dir), "company_id")
    return rows.select("company_id", "strongest", "weakest", F.array_join("omitted", ",").alias("omitted"), F.size("citations").cast("long").alias("n_citations"))


def json_within_bodies(spark, sf_dir):
    """Objects in all pages: a body that is JSON, one that holds some, one that is cut off, and pages as they are."""
    i = F.col("page_id").cast("string")
    body = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(' {"sku": {"id": '), i, F.lit("}} "))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("<html>items = {\"sku\": {\"id\": "), i, F.lit("}};</html>"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit('{"sku": {"id": '), i)).otherwise(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.get_json_object(P.json_within(body), "$.sku.id").cast("long").alias("sku"))


def harmonised_months(spark, sf_dir):
    """All months of all order priorities out of quarters (the first two) and years (the others)."""
    annual = monthly(spark, sf_dir).groupBy("series", F.trunc("period", "YEAR").alias("period")).agg(F.round(F.sum("value"), 2).alias("value")).withColumn("freq", F.lit("A"))
    quarters = quarterly(spark, sf_dir).withColumn("freq", F.when(F.col("series") < "3", "Q").otherwise("H"))  # of an odd frequency elsewhere, which counts for none
    return W.harmonised(annual.unionByName(quarters), ["series"]).withColumn("value", F.round("value", 2))


def macro_load_order(spark, sf_dir):
    """The macro frame twice: by the table, of which the target alone is cleaned, and by an artifact written from it."""
    folder = new_folder(spark, "macro")
    rows = monthly(spark, sf_dir).select("period", "value", "series")
    series = {"iip": F.col("series") == "1-URGENT", "indigo": F.col("series") == "2-HIGH", "mei_bci": F.col("series") == "5-LOW"}
    by_table = FT.load_macro(spark, f"{folder}/none", rows, series)
    by_table.drop("source").withColumn("mei_bci", F.lit(1.0)).write.parquet(f"{folder}/cleaned")
    return by_table.unionByName(FT.load_macro(spark, f"{folder}/cleaned", rows, series)).withColumn("iip", F.round("iip", 2))


def job_lifecycle(spark, sf_dir):
    """All events as a log of jobs: each job's current row, its message as error or detail."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("running")
    log = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("job_name"), status.alias("status"), F.col("event_id").alias("records_processed"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("error_message"), F.col("ts").alias("at"))
    return T.job_messages(T.job_state(log)).select("id", "status", "records_processed", "error", "detail", "created_at")


def name_sets(spark, sf_dir):
    """For each user the types of its events: canonical ones first, and whether they are all among the known."""
    types = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    known = F.array(*map(F.lit, ("view", "click", "purchase", "signup")))
    return types.select("user_id", F.array_join(T.canonical_first(("view", "purchase"), F.col("types")), ",").alias("names"), T.is_subset(F.col("types"), known).alias("all_known"))


def top_gains(spark, sf_dir):
    """The three parts of the largest gains (revenue above the part's mean price times quantity) of each ship mode's line status."""
    ls = read(spark, sf_dir, "lineitem")
    gains = ls.groupBy("l_linestatus", F.col("l_partkey").cast("string").alias("feature")).agg(F.round(F.sum("l_extendedprice") - 30_000 * F.count("*"), 2).alias("gain"))
    return T.top_drivers(gains, ["l_linestatus"])


QUERIES = {f.__name__: f for f in (harmonised_months, macro_load_order, job_lifecycle, name_sets, top_gains, benchmark_reports, json_within_bodies, segmented_features, segmented_asof, kept_observations, keyed_table_merges, landed_lines, forest_anomalies, recurrent_forecast, walk_forward_sql)}
SQL = {
    "harmonised_months": f"""WITH {QUARTERLY}, n AS (SELECT series, period AS p, value AS v, lead(period) OVER w AS np, lead(value) OVER w AS nv FROM quarterly WHERE series < '3' WINDOW w AS (PARTITION BY series ORDER BY period)),
 s AS (SELECT *, coalesce(datediff('month', p, np), 3) AS span FROM n), y AS (SELECT series, CAST(date_trunc('year', period) AS DATE) AS p, round(sum(value), 2) AS value FROM monthly WHERE series >= '3' GROUP BY 1, 2)
 SELECT series, CAST(p + to_months(CAST(i AS INTEGER)) AS DATE) AS period, round(v + (coalesce(nv, v) - v) * i / span, 2) AS value FROM s, range(200) AS r(i) WHERE i < span
 UNION ALL SELECT series, CAST(p + to_months(CAST(i AS INTEGER)) AS DATE), value FROM y, range(12) AS r(i)""",
    "job_lifecycle": """WITH e AS (SELECT user_id, ts, arg_max({'e': event_id, 't': event_type}, ts) OVER (PARTITION BY user_id) AS l, min(ts) OVER (PARTITION BY user_id) AS created_at, row_number() OVER (PARTITION BY user_id) AS n FROM events),
 s AS (SELECT user_id AS id, CASE l.t WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'running' END AS status, l.e AS records_processed, created_at FROM e WHERE n = 1)
 SELECT id, status, records_processed, CASE WHEN status = 'failed' THEN 'm' || records_processed END AS error, CASE WHEN status <> 'failed' THEN 'm' || records_processed END AS detail, created_at FROM s""",
    "name_sets": """WITH t AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS t FROM events GROUP BY 1)
 SELECT user_id, array_to_string(list_concat(['view', 'purchase'], list_filter(t, lambda x: x NOT IN ('view', 'purchase'))), ',') AS names, len(list_filter(t, lambda x: x NOT IN ('view', 'click', 'purchase', 'signup'))) = 0 AS all_known FROM t""",
    "top_gains": """WITH g AS (SELECT l_linestatus, CAST(l_partkey AS VARCHAR) AS feature, round(sum(l_extendedprice) - 30000 * count(*), 2) AS gain FROM lineitem GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY gain DESC, feature) AS place FROM g WHERE gain > 0 QUALIFY place <= 3""",
    "benchmark_reports": f"""WITH b AS ({firms.SQL["benchmark_full"]}), s AS (SELECT *, value IS NOT NULL AND peers > 0 AS said FROM b),
 r AS (SELECT company_id, min({{'p': -percentile, 'm': metric}}) FILTER (WHERE said AND percentile IS NOT NULL) AS best, min({{'p': percentile, 'm': metric}}) FILTER (WHERE said AND percentile IS NOT NULL) AS worst,
   coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE NOT said), '') AS omitted FROM s GROUP BY 1)
 SELECT company_id, best.m AS strongest, CASE WHEN best.m <> worst.m THEN worst.m END AS weakest, omitted, CAST(CASE WHEN best IS NULL THEN 0 WHEN best.m = worst.m THEN 3 ELSE 6 END AS BIGINT) AS n_citations FROM r""",
    "json_within_bodies": "SELECT page_id, CASE WHEN page_id % 4 < 2 THEN page_id END AS sku FROM pages",
    "segmented_features": """WITH e AS (SELECT event_id, CASE WHEN NOT (event_id % 13 < 4 AND event_id % 3 > 0 OR event_id % 500 BETWEEN 200 AND 210) THEN value END AS value FROM events),
 a AS (SELECT *, row_number() OVER w AS row, lag(value) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3, avg(value) OVER (ORDER BY event_id ROWS 2 PRECEDING) AS roll, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held,
   count(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e WINDOW w AS (ORDER BY event_id)),
 b AS (SELECT *, lag(held) OVER (ORDER BY event_id) AS before, CASE WHEN value IS NULL THEN count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY run) ELSE 0 END AS gap_rows,
   max(CASE WHEN value IS NOT NULL THEN row END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS pr, min(CASE WHEN value IS NOT NULL THEN row END) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr,
   first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM a),
 c AS (SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN nr IS NULL THEN held ELSE held + (nv - held) * (row - pr) / (nr - pr) END AS filled FROM b)
 SELECT event_id, value_lag1, value_lag3, round(roll, 6) AS value_roll3m, round(held / nullif(before, 0) - 1, 6) AS growth, CAST(gap_rows AS BIGINT) AS gap_rows, round(filled, 6) AS value_filled,
   CASE WHEN gap_rows = 0 THEN 'observed' WHEN filled IS NULL THEN 'missing' WHEN gap_rows <= 3 THEN 'short' ELSE 'long' END AS fill_kind FROM c""",
    "segmented_asof": """WITH p AS (SELECT ts, max(event_id) AS purchase_id, max(value) AS purchase_value FROM events WHERE event_type = 'purchase' GROUP BY 1)
 SELECT event_id, purchase_id, purchase_value FROM events AS e ASOF LEFT JOIN p ON e.ts >= p.ts""",
    "landed_lines": """SELECT event_type AS type, CASE WHEN event_id % 50 = 0 THEN 'not_json' WHEN event_id % 77 = 0 THEN 'bad_event_id' END AS reason, count(*) AS n,
 CAST(sum(CASE WHEN reason IS NULL THEN user_id END) AS BIGINT) AS users, round(sum(CASE WHEN reason IS NULL THEN value END), 2) AS total FROM events GROUP BY 1, 2""",
    "walk_forward_sql": """WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) - 1 AS at, count(*) OVER (PARTITION BY series) AS n FROM m),
 f AS (SELECT a.series, (a.at - 24) // 6 AS fold, a.value AS actual, b.value AS predicted FROM r AS a JOIN r AS b ON a.series = b.series AND b.at = 24 + (a.at - 24) // 6 * 6 - 1 WHERE a.at >= 24 AND 24 + (a.at - 24) // 6 * 6 + 6 <= a.n),
 e AS (SELECT series, fold, round(avg(abs(actual - predicted)), 4) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse, round(coalesce(avg(abs((actual - predicted) / nullif(actual, 0))) * 100, 0), 4) AS mape FROM f GROUP BY 1, 2)
 SELECT series, count(*) AS folds, round(avg(mae), 2) AS mae, round(avg(rmse), 2) AS rmse, round(avg(mape), 2) AS mape FROM e GROUP BY 1""",
    "kept_observations": "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(value, ts) AS value, max(ts) AS at FROM events WHERE event_type <> 'error' GROUP BY 1",
    "keyed_table_merges": """WITH a AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
 b AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max({'v': CASE WHEN event_id % 3 > 0 THEN value END}, event_id).v AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
 SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, coalesce(b.event_id, a.event_id) AS event_id, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
}
