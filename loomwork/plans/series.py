"""Queries over time series: lags, gaps, outliers, step-hold, as-of joins, folds. Series are daily events and monthly orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import evaluation as E
from ..operators import windows as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: bytes of a file that are read as one piece where its rows' double sums are rounded (Spark's own bound changes with table and cores).
PIECE = 8 << 20


def read_in_pieces(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row's piece (``file``, ``start``): at most ``PIECE`` bytes, those of one row group or file where these are no smaller.

    Sums of doubles depend on what is added first, and where they are half a cent, so does the rounded sum. Sums of pieces,
    added by :func:`added_in_order`, are the same whatever the cores, the tasks and the order in which these end. The bound is
    set in a session of the table's own with the settings of ``spark``; other tables keep theirs. Beyond 10 000 tasks pieces share one.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", PIECE)
    own.conf.set("spark.sql.files.minPartitionNum", 1)  # else more cores cut smaller pieces
    own.conf.set("spark.sql.files.maxPartitionNum", 10_000)
    return read(own, sf_dir, name).withColumns({"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")})


def added_in_order(sums: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Sums by ``keys`` and ``place`` added up by ``keys`` in the order of ``place``, as running sums that spill."""
    columns = [c for c in sums.columns if c not in (*keys, *place)]
    so_far = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select(*keys, *place, *(F.sum(c).over(so_far).alias(c) for c in columns))
    return running.groupBy(*keys).agg(*(F.max_by(c, F.struct(*place)).alias(c) for c in columns))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, period, value): events by type and day."""
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("period")).agg(F.round(F.sum("value"), 2).alias("value"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with gaps of one to four days."""
    gone = F.pmod(F.day("period") * 3 + F.length("series"), F.lit(11)).isin(0, 3, 6, 9) | F.day("period").isin(12, 13, 14)
    return daily(spark, sf_dir).withColumn("value", F.when(~gone, F.col("value")))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, period, value): order value by priority and month."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc(F.to_date("o_orderdate"), "MM").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("series", F.trunc("period", "QUARTER").alias("period")).agg(F.round(F.sum("value"), 2).alias("value"))


DAILY = """daily AS (SELECT event_type AS series, CAST(ts AS DATE) AS period, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"""
MASKED = DAILY + """, masked AS (SELECT series, period, CASE WHEN NOT ((day(period) * 3 + length(series)) % 11 IN (0, 3, 6, 9) OR day(period) IN (12, 13, 14)) THEN value END AS value FROM daily)"""
MONTHLY = """monthly AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"""
QUARTERLY = MONTHLY + """, quarterly AS (SELECT series, CAST(date_trunc('quarter', period) AS DATE) AS period, round(sum(value), 2) AS value FROM monthly GROUP BY 1, 2)"""
#: Rows numbered, gaps measured and interpolated, as the operators define it.
LINE = MASKED + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) AS r, count(value) OVER (PARTITION BY series ORDER BY period ROWS UNBOUNDED PRECEDING) AS run FROM masked),
 sided AS (SELECT *, CASE WHEN value IS NULL THEN count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY series, run) ELSE 0 END AS gap,
   last_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER p AS pr, last_value(value IGNORE NULLS) OVER p AS pv,
   first_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER n AS nr, first_value(value IGNORE NULLS) OVER n AS nv
   FROM numbered WINDOW p AS (PARTITION BY series ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY series ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 line AS (SELECT series, period, value, gap, coalesce(value, pv + (nv - pv) * (r - pr) / nullif(nr - pr, 0), pv) AS filled FROM sided),
 kinds AS (SELECT *, CASE WHEN gap = 0 THEN 'observed' WHEN filled IS NULL THEN 'missing' WHEN gap <= 2 THEN 'short' ELSE 'long' END AS fill_kind FROM line)"""
CLEAN = LINE + """, q AS (SELECT series, quantile_cont(filled, 0.25) AS q1, quantile_cont(filled, 0.5) AS q2, quantile_cont(filled, 0.75) AS q3 FROM kinds GROUP BY 1),
 flagged AS (SELECT k.*, q2, q1 - nullif(q3 - q1, 0) * 0.5 AS low, q3 + nullif(q3 - q1, 0) * 0.5 AS high FROM kinds AS k JOIN q ON k.series = q.series),
 marked AS (SELECT *, coalesce(filled < low OR filled > high, false) AS is_outlier FROM flagged)"""


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def lag_roll_growth_features(spark, sf_dir):
    s = masked(spark, sf_dir)
    out = W.growth(W.rolling_means(W.lags(s, ["series"], "value"), ["series"], "value"), ["series"], "value", "growth")
    return rounded(out.withColumn("cross", F.col("value_lag1") * F.col("growth")), "value_roll3m", "value_roll6m", "growth", "cross")


def gap_fill_linear(spark, sf_dir):
    return rounded(W.gaps_filled(masked(spark, sf_dir), ["series"], "value"), "value_filled")


def gap_fill_short_only(spark, sf_dir):
    return rounded(W.gaps_filled(masked(spark, sf_dir), ["series"], "value", long_gaps=False), "value_filled")


def gap_fill_provenance(spark, sf_dir):
    return C.provenance(C.clean_series(masked(spark, sf_dir), ["series"], iqr_factor=0.5), ["series"])


def cleaned(action):
    return lambda spark, sf_dir: rounded(C.clean_series(masked(spark, sf_dir), ["series"], action=action, iqr_factor=0.5), "value_clean")


def outlier_iqr_flags(spark, sf_dir):
    return C.with_fences(daily(spark, sf_dir), ["series"], "value", iqr_factor=0.5).select("series", "period", "value", "is_outlier")


def outlier_zscore_flags(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_brand").alias("series"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    return C.with_fences(parts, ["series"], "value", method="zscore", zscore=1.5).select("series", "id", "value", "is_outlier")


def step_hold_months(spark, sf_dir):
    yearly = monthly(spark, sf_dir).groupBy("series", F.trunc("period", "YEAR").alias("period")).agg(F.round(F.sum("value"), 2).alias("value"))
    return W.step_held(yearly, 12)


def quarter_linear_months(spark, sf_dir):
    return rounded(W.quarters_to_months(quarterly(spark, sf_dir), ["series"]), "value", digits=2)


def freq_preference(spark, sf_dir):
    annual = monthly(spark, sf_dir).groupBy("series", F.trunc("period", "YEAR").alias("period")).agg(F.round(F.sum("value"), 2).alias("value")).withColumn("freq", F.lit("A"))
    # every series has quarters, which count as such for some alone
    quarters = quarterly(spark, sf_dir).withColumn("freq", F.when(F.col("series") < "3", "Q").otherwise("H"))
    return W.preferred_frequency(annual.unionByName(quarters), ["series"])


def snapshots(spark, sf_dir):
    """Values of single months of each series, two of the year's."""
    return monthly(spark, sf_dir).where(F.month("period").isin(2, 9)).select("series", "period", F.col("value").alias("snapshot"), F.col("period").alias("snapshot_period"))


def asof_backward_features(spark, sf_dir):
    return W.asof_backward(monthly(spark, sf_dir), snapshots(spark, sf_dir), ["series"], ["snapshot", "snapshot_period"])


def broadcast_latest(spark, sf_dir):
    s = monthly(spark, sf_dir)
    one = s.agg(F.max_by("value", F.struct("period", "series")).alias("latest_value"), F.max("period").alias("latest_period"))
    return W.broadcast_latest(s.select("series", "period"), one, ["latest_value", "latest_period"])


def financial_step_hold(spark, sf_dir):
    q = quarterly(spark, sf_dir)
    by_period = q.groupBy("period").agg(F.round(F.avg("value"), 2).alias("mean_value"), F.count("*").alias("n"))
    calendar = monthly(spark, sf_dir).select("period").distinct()
    return calendar.join(W.step_held(by_period, 3), "period", "left")


def mom_yoy(spark, sf_dir):
    return rounded(W.month_on_month(monthly(spark, sf_dir), ["series"], "value"), "mom_pct", "yoy_pct")


def series_monthly_wide_outer(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("orders_value"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("lines_value"))
    events = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.sum("value"), 2).alias("events_value"))
    return orders.join(lines, "month", "full").join(events, "month", "full")


def monthly_continuity(spark, sf_dir):
    return W.is_monthly(snapshots(spark, sf_dir).union(monthly(spark, sf_dir).select(F.concat(F.lit("all "), "series"), "period", "value", "period")), ["series"])


def supervised_sequences(spark, sf_dir):
    rows = W.sequences(monthly(spark, sf_dir), ["series"], "value")
    return rows.select("series", "period", F.array_max("x").alias("x_max"), F.col("x")[0].alias("x_first"), F.col("y")[5].alias("y_last"))


def lag_identity_violations(spark, sf_dir):
    lagged = W.lags(monthly(spark, sf_dir), ["series"], "value", (1, 2))
    broken = lagged.withColumn("value_lag2", F.when(F.month("period") == 7, F.col("value_lag2") + 1).otherwise(F.col("value_lag2")))
    # lags are copies here: an error of 1 counts at any size of the values
    return W.lag_violations(broken, ["series"], "value", "value_lag2", 2, rtol=0.0, atol=0.0).select("series", "period", "value_lag2")


def walk_forward_folds(spark, sf_dir):
    folds = W.walk_forward(monthly(spark, sf_dir), ["series"], min_train=24, test_size=6, step=6)
    return folds.groupBy("series", "fold", "role").agg(F.count("*").alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.round(F.sum("value"), 1).alias("total"))


def walk_forward_rolling(spark, sf_dir):
    folds = W.walk_forward(monthly(spark, sf_dir), ["series"], min_train=24, test_size=3, step=12, mode="rolling")
    return folds.select("series", "period", "fold", "role")


def naive(spark, sf_dir):
    return W.lags(monthly(spark, sf_dir), ["series"], "value", (1,)).withColumn("predicted", F.col("value_lag1"))


def error_metrics(spark, sf_dir):
    return E.errors(naive(spark, sf_dir), ["series"], "value", "predicted")


def fold_error_means(spark, sf_dir):
    """Errors of the last train value, held over each fold's test months, and their means over the folds."""
    folds = W.walk_forward(monthly(spark, sf_dir), ["series"], min_train=24, test_size=6, step=6)
    last = folds.where("role = 'train'").groupBy("series", "fold").agg(F.max_by("value", "period").alias("predicted"))
    return E.fold_means(folds.where("role = 'test'").join(last, ["series", "fold"]), ["series"], "value", "predicted")


def forecast_union_bridge(spark, sf_dir):
    """Actuals and, from the last of them on, a held forecast, in one frame."""
    s = monthly(spark, sf_dir)
    last = s.groupBy("series").agg(F.max_by(F.struct("period", "value"), "period").alias("l"))
    future = last.select("series", F.explode(W.months_of(F.col("l.period"), 4)).alias("period"), F.col("l.value").alias("value")).withColumn("kind", F.lit("forecast"))
    return s.withColumn("kind", F.lit("actual")).unionByName(future)


def pivot_predictions(spark, sf_dir):
    s = daily(spark, sf_dir)
    kinds = ["click", "purchase", "view"]
    return s.where(F.col("series").isin(kinds)).groupBy("period").pivot("series", kinds).agg(F.first("value"))


QUERIES = {
    "lag_roll_growth_features": lag_roll_growth_features, "gap_fill_linear": gap_fill_linear, "gap_fill_short_only": gap_fill_short_only, "gap_fill_provenance": gap_fill_provenance,
    "outlier_median": cleaned("median"), "outlier_winsorize": cleaned("winsorize"), "outlier_null": cleaned("null"), "outlier_iqr_flags": outlier_iqr_flags, "outlier_zscore_flags": outlier_zscore_flags,
    "step_hold_months": step_hold_months, "quarter_linear_months": quarter_linear_months, "freq_preference": freq_preference, "asof_backward_features": asof_backward_features,
    "broadcast_latest": broadcast_latest, "financial_step_hold": financial_step_hold, "mom_yoy": mom_yoy, "series_monthly_wide_outer": series_monthly_wide_outer, "monthly_continuity": monthly_continuity,
    "supervised_sequences": supervised_sequences, "lag_identity_violations": lag_identity_violations, "walk_forward_folds": walk_forward_folds, "walk_forward_rolling": walk_forward_rolling,
    "error_metrics": error_metrics, "fold_error_means": fold_error_means, "forecast_union_bridge": forecast_union_bridge, "pivot_predictions": pivot_predictions,
}

ACTED = {"median": "q2", "winsorize": "least(greatest(filled, low), high)", "null": "NULL"}
ERRORS = "round(avg(abs(value - predicted)), 4) AS mae, round(sqrt(avg((value - predicted) * (value - predicted))), 4) AS rmse, round(coalesce(avg(CASE WHEN value <> 0 THEN abs((value - predicted) / value) END) * 100, 0), 4) AS mape"
FOLDS = "nf AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM monthly), ff AS (SELECT nf.*, f.fold, {o} AS origin FROM nf, (SELECT CAST(unnest(range(0, 200)) AS BIGINT) AS fold) AS f WHERE {o} + {t} <= n)"
FOLDS6, FOLDS12 = FOLDS.format(o="24 + f.fold * 6", t=6), FOLDS.format(o="24 + f.fold * 12", t=3)
SQL = {
    "lag_roll_growth_features": f"""WITH {MASKED}, held AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY period ROWS UNBOUNDED PRECEDING) AS h FROM masked),
 f AS (SELECT series, period, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(value, 3) OVER w AS value_lag3,
   avg(value) OVER (PARTITION BY series ORDER BY period ROWS 2 PRECEDING) AS r3, avg(value) OVER (PARTITION BY series ORDER BY period ROWS 5 PRECEDING) AS r6, h / nullif(lag(h) OVER w, 0) - 1 AS g FROM held WINDOW w AS (PARTITION BY series ORDER BY period))
 SELECT series, period, value, value_lag1, value_lag2, value_lag3, round(r3, 4) AS value_roll3m, round(r6, 4) AS value_roll6m, round(g, 4) AS growth, round(value_lag1 * g, 4) AS cross FROM f""".replace("AS cross", 'AS "cross"'),
    "gap_fill_linear": f"WITH {LINE} SELECT series, period, value, round(filled, 4) AS value_filled, fill_kind FROM kinds",
    "gap_fill_short_only": f"WITH {LINE} SELECT series, period, value, CASE WHEN gap <= 2 THEN round(filled, 4) END AS value_filled, CASE WHEN gap > 2 THEN 'missing' ELSE fill_kind END AS fill_kind FROM kinds",
    "gap_fill_provenance": f"""WITH {CLEAN} SELECT series, count(*) AS n_rows, count(*) FILTER (WHERE fill_kind = 'observed') AS n_observed, count(*) FILTER (WHERE fill_kind = 'short') AS n_short_filled,
 count(*) FILTER (WHERE fill_kind = 'long') AS n_long_filled, count(*) FILTER (WHERE fill_kind = 'missing') AS n_missing, count(*) FILTER (WHERE is_outlier) AS n_outliers FROM marked GROUP BY 1""",
    **{f"outlier_{a}": f"WITH {CLEAN} SELECT series, period, value, fill_kind, is_outlier, round(CASE WHEN is_outlier THEN {x} ELSE filled END, 4) AS value_clean FROM marked" for a, x in ACTED.items()},
    "outlier_iqr_flags": f"""WITH {DAILY}, q AS (SELECT series, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM daily GROUP BY 1)
 SELECT daily.series, period, value, coalesce(value < a - nullif(b - a, 0) * 0.5 OR value > b + nullif(b - a, 0) * 0.5, false) AS is_outlier FROM daily JOIN q ON daily.series = q.series""",
    "outlier_zscore_flags": """WITH s AS (SELECT p_brand, avg(p_retailprice) AS m, nullif(stddev_pop(p_retailprice), 0) AS s FROM part GROUP BY 1)
 SELECT p.p_brand AS series, p_partkey AS id, p_retailprice AS value, coalesce(p_retailprice < m - 1.5 * s OR p_retailprice > m + 1.5 * s, false) AS is_outlier FROM part AS p JOIN s ON p.p_brand = s.p_brand""",
    "step_hold_months": f"""WITH {MONTHLY}, y AS (SELECT series, CAST(date_trunc('year', period) AS DATE) AS p, round(sum(value), 2) AS value FROM monthly GROUP BY 1, 2)
 SELECT series, CAST(p + to_months(CAST(i AS INTEGER)) AS DATE) AS period, value FROM y, range(12) AS r(i)""",
    "quarter_linear_months": f"""WITH {QUARTERLY}, n AS (SELECT series, period AS p, value AS v, lead(period) OVER w AS np, lead(value) OVER w AS nv FROM quarterly WINDOW w AS (PARTITION BY series ORDER BY period)),
 s AS (SELECT *, coalesce(datediff('month', p, np), 3) AS span FROM n)
 SELECT series, CAST(p + to_months(CAST(i AS INTEGER)) AS DATE) AS period, round(v + (coalesce(nv, v) - v) * i / span, 2) AS value FROM s, range(200) AS r(i) WHERE i < span""",
    "freq_preference": f"""WITH {QUARTERLY} SELECT series, CAST(date_trunc('year', period) AS DATE) AS period, round(sum(value), 2) AS value, 'A' AS freq FROM monthly WHERE series >= '3' GROUP BY 1, 2
 UNION ALL SELECT series, period, value, CASE WHEN series < '3' THEN 'Q' ELSE 'H' END AS freq FROM quarterly""",
    "asof_backward_features": f"""WITH {MONTHLY}, s AS (SELECT series, period AS snapshot_period, value AS snapshot FROM monthly WHERE month(period) IN (2, 9))
 SELECT m.series, m.period, m.value, s.snapshot, s.snapshot_period FROM monthly AS m ASOF LEFT JOIN s ON m.series = s.series AND m.period >= s.snapshot_period""",
    "broadcast_latest": f"""WITH {MONTHLY}, one AS (SELECT value AS latest_value, period AS latest_period FROM monthly ORDER BY period DESC, series DESC LIMIT 1) SELECT series, period, latest_value, latest_period FROM monthly, one""",
    "financial_step_hold": f"""WITH {QUARTERLY}, a AS (SELECT period AS p, round(avg(value), 2) AS mean_value, count(*) AS n FROM quarterly GROUP BY 1), c AS (SELECT DISTINCT period FROM monthly)
 SELECT c.period, mean_value, n FROM c LEFT JOIN a ON CAST(date_trunc('quarter', c.period) AS DATE) = a.p""",
    "mom_yoy": f"""WITH {MONTHLY} SELECT m.series, m.period, m.value, round((m.value - lag(m.value) OVER w) / nullif(lag(m.value) OVER w, 0) * 100, 4) AS mom_pct, round((m.value - y.value) / nullif(y.value, 0) * 100, 4) AS yoy_pct
 FROM monthly AS m LEFT JOIN monthly AS y ON m.series = y.series AND y.period = CAST(m.period - INTERVAL 12 MONTH AS DATE) WINDOW w AS (PARTITION BY m.series ORDER BY m.period)""",
    "series_monthly_wide_outer": """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS orders_value FROM orders GROUP BY 1),
 l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_extendedprice), 2) AS lines_value FROM lineitem GROUP BY 1), e AS (SELECT strftime(ts, '%Y-%m') AS month, round(sum(value), 2) AS events_value FROM events GROUP BY 1)
 SELECT coalesce(o.month, l.month, e.month) AS month, orders_value, lines_value, events_value FROM o FULL JOIN l ON o.month = l.month FULL JOIN e ON coalesce(o.month, l.month) = e.month""",
    "monthly_continuity": f"""WITH {MONTHLY}, u AS (SELECT series, period FROM monthly WHERE month(period) IN (2, 9) UNION ALL SELECT 'all ' || series, period FROM monthly), m AS (SELECT DISTINCT series, year(period) * 12 + month(period) AS m FROM u)
 SELECT series, count(*) > 1 AND max(m) - min(m) + 1 = count(*) AS is_monthly FROM m GROUP BY 1""",
    "supervised_sequences": f"""WITH {MONTHLY}, w AS (SELECT series, period, array_agg(value) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x, array_agg(value) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS y FROM monthly)
 SELECT series, period, list_max(x) AS x_max, x[1] AS x_first, y[6] AS y_last FROM w WHERE len(x) = 12 AND len(y) = 6""",
    "lag_identity_violations": f"""WITH {MONTHLY}, l AS (SELECT series, period, lag(value, 2) OVER (PARTITION BY series ORDER BY period) AS v FROM monthly) SELECT series, period, v + 1 AS value_lag2 FROM l WHERE month(period) = 7 AND v IS NOT NULL""",
    "walk_forward_folds": f"""WITH {MONTHLY}, {FOLDS6} SELECT series, fold, CASE WHEN pos < origin THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(period) AS first_period, max(period) AS last_period, round(sum(value), 1) AS total FROM ff WHERE pos < origin + 6 GROUP BY 1, 2, 3""",
    "walk_forward_rolling": f"""WITH {MONTHLY}, {FOLDS12} SELECT series, period, fold, CASE WHEN pos < origin THEN 'train' ELSE 'test' END AS role FROM ff WHERE pos >= origin - 24 AND pos < origin + 3""",
    "error_metrics": f"""WITH {MONTHLY}, p AS (SELECT series, value, lag(value) OVER (PARTITION BY series ORDER BY period) AS predicted FROM monthly) SELECT series, count(*) AS n, {ERRORS} FROM p WHERE predicted IS NOT NULL GROUP BY 1""",
    "fold_error_means": f"""WITH {MONTHLY}, {FOLDS6}, t AS (SELECT series, fold, max_by(value, period) AS predicted FROM ff WHERE pos < origin GROUP BY 1, 2),
 e AS (SELECT ff.series, ff.fold, {ERRORS} FROM ff JOIN t ON ff.series = t.series AND ff.fold = t.fold WHERE pos >= origin AND pos < origin + 6 GROUP BY 1, 2)
 SELECT series, count(*) AS folds, round(avg(mae), 2) AS mae, round(avg(rmse), 2) AS rmse, round(avg(mape), 2) AS mape FROM e GROUP BY 1""",
    "forecast_union_bridge": f"""WITH {MONTHLY}, l AS (SELECT series, max(period) AS p, max_by(value, period) AS v FROM monthly GROUP BY 1)
 SELECT series, period, value, 'actual' AS kind FROM monthly UNION ALL SELECT series, CAST(p + to_months(CAST(i AS INTEGER)) AS DATE), v, 'forecast' FROM l, range(4) AS r(i)""",
    "pivot_predictions": f"""WITH {DAILY} SELECT period, max(CASE WHEN series = 'click' THEN value END) AS click, max(CASE WHEN series = 'purchase' THEN value END) AS purchase, max(CASE WHEN series = 'view' THEN value END) AS "view"
 FROM daily WHERE series IN ('click', 'purchase', 'view') GROUP BY 1""",
}
