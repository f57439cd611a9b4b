"""Queries over models and the feature frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import features as FT
from ..operators import models as M
from ..operators import windows as W
from . import firms
from .series import daily, monthly, read


def frame(spark, sf_dir):
    """Features of each series' months."""
    s = monthly(spark, sf_dir)
    out = W.growth(W.rolling_means(W.lags(s, ["series"], "value"), ["series"], "value"), ["series"], "value", "growth")
    return out.dropna(subset=["value_lag3"])


FEATURES = ["value_lag1", "value_lag2", "value_lag3", "value_roll3m", "value_roll6m"]


def gbt_holdout(spark, sf_dir):
    _, predicted = M.holdout(frame(spark, sf_dir), "value", FEATURES, "2000-06")
    return predicted.select("series", "period", "value", "predicted")


PRICED = ["l_quantity", "l_discount", "l_tax"]


def boosted_stump(spark, sf_dir):
    """The first split of a booster over all line items, two of whose features are null here and there, and its leaves."""
    ls = read(spark, sf_dir, "lineitem")
    rows = ls.select((F.col("l_extendedprice") / 1000).alias("y"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_discount")).alias("l_discount"), "l_tax")
    nodes = B.node_table(spark, B.fit(rows, "y", PRICED, B.Profile(trees=1, depth=1)))
    return nodes.select("node", "feature", "threshold", "null_left", F.round("value", 6).alias("value"), F.round("gain", 2).alias("gain"), "rows")


def arima_forecast(spark, sf_dir):
    return M.arima(monthly(spark, sf_dir), "series")


def window_forecast(spark, sf_dir):
    return M.window_forecast(monthly(spark, sf_dir), "series")


def anomaly_scores(spark, sf_dir):
    return M.anomalies(daily(spark, sf_dir), "series")


def categorize_abstain(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("name"), F.col("p_type").alias("code"))
    labelled = parts.withColumn("code", F.when(F.col("p_partkey") % 3 > 0, F.col("code")))
    model = M.train_categorizer(labelled, "name", "code", key="p_partkey")
    return M.categorize(model, parts.drop("code"), "name", M.known_codes(parts, "code"))


def macro(spark, sf_dir):
    o = monthly(spark, sf_dir)
    return o.groupBy("period").agg(F.round(F.sum("value"), 2).alias("iip"), F.round(F.max("value"), 2).alias("indigo"))


def digital_snapshots(spark, sf_dir):
    m = F.months_between(F.lit("2001-01-01").cast("date"), "period")
    return monthly(spark, sf_dir).where("month(period) IN (3, 8)").select("period", F.round(F.year("period") % 10 / 10.0, 2).alias("digital_adoption_score"), F.lit(0.5).alias("channel_diversity"), (F.round(m) / 1000).alias("online_revenue_ratio"))


def feature_frame(spark, sf_dir):
    rows = FT.build(macro(spark, sf_dir), digital_snapshots(spark, sf_dir), firms.reports(spark, sf_dir))
    return rows.select("period", "iip", "iip_lag1", "iip_lag3", F.round("iip_roll3m", 2).alias("iip_roll3m"), F.round("iip_growth", 6).alias("iip_growth"), "indigo_lag1", F.round("digital_adoption_score", 4).alias("digital_adoption_score"), F.round("online_revenue_ratio", 4).alias("online_revenue_ratio"), "digital_alignment", F.round("roa", 6).alias("roa"), F.round("current_ratio", 4).alias("current_ratio"), "financial_alignment")


def feature_manifest(spark, sf_dir):
    return FT.manifest(FT.build(macro(spark, sf_dir), digital_snapshots(spark, sf_dir), firms.reports(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (gbt_holdout, boosted_stump, arima_forecast, window_forecast, anomaly_scores, categorize_abstain, feature_frame, feature_manifest)}
FRAME = firms.REPORTS + """, monthly AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
 macro AS (SELECT period, round(sum(value), 2) AS iip, round(max(value), 2) AS indigo FROM monthly GROUP BY 1),
 snap AS (SELECT DISTINCT period AS p, round((year(period) % 10) / 10, 2) AS digital_adoption_score, round(datediff('month', period, DATE '2001-01-01')) / 1000 AS online_revenue_ratio FROM monthly WHERE month(period) IN (3, 8)),
 fin AS (SELECT period AS q, avg(net_profit / nullif(total_assets, 0)) AS roa, avg(current_assets / nullif(current_liabilities, 0)) AS current_ratio, bool_and(report_type = 'annual') AS annual FROM reports GROUP BY 1),
 f AS (SELECT m.period, iip, lag(iip) OVER w AS iip_lag1, lag(iip, 3) OVER w AS iip_lag3, lag(iip, 2) OVER w AS iip_lag2, avg(iip) OVER (ORDER BY m.period ROWS 2 PRECEDING) AS r3, iip / lag(iip) OVER w - 1 AS g, lag(indigo) OVER w AS indigo_lag1, digital_adoption_score, online_revenue_ratio,
   roa, current_ratio, annual FROM macro AS m ASOF LEFT JOIN snap ON m.period >= snap.p LEFT JOIN fin ON CASE WHEN annual THEN date_trunc('year', m.period) = date_trunc('year', q) ELSE date_trunc('quarter', m.period) = date_trunc('quarter', q) END WINDOW w AS (ORDER BY m.period))"""
SQL = {
    "boosted_stump": """WITH r AS (SELECT l_extendedprice / 1000 AS y, CASE WHEN l_linenumber % 5 > 0 THEN l_quantity END AS q, CASE WHEN l_orderkey % 3 > 0 THEN l_discount END AS d, l_tax AS t FROM lineitem),
 g AS (SELECT *, avg(y) OVER () - y AS g FROM r), a AS (SELECT sum(g) AS g, CAST(count(*) AS DOUBLE) AS n FROM g),
 long AS (SELECT 0 AS j, 'l_quantity' AS feature, q AS x, g FROM g UNION ALL SELECT 1, 'l_discount', d, g FROM g UNION ALL SELECT 2, 'l_tax', t, g FROM g),
 bins AS (SELECT j, feature, x, sum(g) AS g, count(*) AS n FROM long WHERE x IS NOT NULL GROUP BY 1, 2, 3), nulls AS (SELECT j, coalesce(sum(g) FILTER (WHERE x IS NULL), 0) AS g0, count(*) FILTER (WHERE x IS NULL) AS n0 FROM long GROUP BY 1),
 run AS (SELECT j, feature, (x + lead(x) OVER w) / 2 AS threshold, sum(g) OVER w AS gl, sum(n) OVER w AS nl FROM bins WINDOW w AS (PARTITION BY j ORDER BY x)),
 c AS (SELECT run.j, feature, threshold, s.s = 1 AS null_left, gl + s.s * g0 AS gl, nl + s.s * n0 AS nl FROM run JOIN nulls ON run.j = nulls.j, (SELECT unnest([0, 1]) AS s) AS s WHERE threshold IS NOT NULL OR s.s = 0 AND n0 > 0),
 best AS (SELECT c.*, a.g, a.n, (gl * gl / (nl + 1) + (a.g - gl) * (a.g - gl) / (n - nl + 1) - a.g * a.g / (n + 1)) / 2 AS gain FROM c, a ORDER BY gain DESC LIMIT 1)
 SELECT 1 AS node, feature, threshold, null_left, round(-0.1 * g / (n + 1), 6) + 0.0 AS value, round(gain, 2) AS gain, CAST(n AS BIGINT) AS rows FROM best UNION ALL SELECT 2, NULL, NULL, NULL, round(-0.1 * gl / (nl + 1), 6), 0, CAST(nl AS BIGINT) FROM best
 UNION ALL SELECT 3, NULL, NULL, NULL, round(-0.1 * (g - gl) / (n - nl + 1), 6), 0, CAST(n - nl AS BIGINT) FROM best""",
    "feature_frame": f"""WITH {FRAME} SELECT period, iip, iip_lag1, iip_lag3, round(r3, 2) AS iip_roll3m, round(g, 6) AS iip_growth, indigo_lag1, digital_adoption_score, round(online_revenue_ratio, 4) AS online_revenue_ratio, 'period_aggregate' AS digital_alignment,
   round(roa, 6) AS roa, round(current_ratio, 4) AS current_ratio, CASE WHEN annual THEN 'step_hold_annual' WHEN NOT annual THEN 'step_hold_quarter' END AS financial_alignment FROM f WHERE iip_lag3 IS NOT NULL""",
}
