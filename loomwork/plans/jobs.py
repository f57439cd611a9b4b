"""Queries over jobs, seeds, dashboards' picks, training and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import jobs as J
from ..operators import text as X
from ..operators import training as TR
from ..operators import windows as W
from ..sources import payloads as P
from . import firms
from .series import CLEAN, DAILY, MONTHLY, daily, masked, monthly, read


def monitor_status(spark, sf_dir):
    """Failed ones among the fifty newest of all events, taken for jobs."""
    e = read(spark, sf_dir, "events")
    return J.monitor_status(e.select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"), F.col("ts").alias("created_at")))


def allowlist_order(spark, sf_dir):
    """Part types as codes in odd writing, in the order in which they come first."""
    p = read(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 9 == 0, "  ").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(F.col("p_brand"))
    return J.allowlist(p.select("p_partkey", code.alias("code")), "code", "p_partkey")


def enrichment_counts(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"))
    k = F.col("code")
    fetched = s.where(k % 5 > 0).withColumn("status", F.when(k % 3 == 0, "ok").when(k % 3 == 1, "fallback").otherwise("broken"))
    return J.enrichment_counts(s, fetched, "code")


def seed_annual_reports(spark, sf_dir):
    """Reports after seeds for every fourth firm: their other annual periods are gone, their quarters are not."""
    r = firms.reports(spark, sf_dir).select("company_id", "period", "report_type", "revenue").withColumn("source_url", F.lit("http://live"))
    seeds = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("1999-12-31")).cast("date").alias("period"), (F.col("s_acctbal") * 10).alias("revenue"))
    return J.seed_reports(r, seeds)


def preferred_statement(spark, sf_dir):
    r = firms.reports(spark, sf_dir).select("company_id", "period", "revenue").withColumn("live", (F.col("company_id") % 3 > 0) & (F.year("period") % 3 == 0))
    return J.preferred_statement(r, "company_id", F.col("live"))


def last_twelve(spark, sf_dir):
    return J.last_points(monthly(spark, sf_dir), ["series"])


def latest_flag(spark, sf_dir):
    """The latest day of each series, if it lies outside of the series' fences."""
    return J.latest_flag(C.with_fences(daily(spark, sf_dir), ["series"], "value", method="zscore", zscore=0.5).withColumnRenamed("is_outlier", "is_anomaly"), ["series"]).select("series", "period", "value")


def reindexed_features(spark, sf_dir):
    """Order values by month on the months of shipping."""
    target = read(spark, sf_dir, "lineitem").select(F.trunc(F.to_date("l_shipdate"), "MM").alias("period"))
    features = monthly(spark, sf_dir).groupBy("period").agg(F.round(F.sum("value"), 0).alias("total"))
    return TR.reindexed(target, features)


def cleaned_macro(spark, sf_dir):
    """All series cleaned in one pass, the one of signups passed through as it is."""
    rows = J.clean_macro(masked(spark, sf_dir), passed=("signup",), iqr_factor=0.5)
    return rows.select("series", "period", "fill_kind", "is_outlier", F.round("value_clean", 4).alias("value_clean"))


def passed_series_metadata(spark, sf_dir):
    d = daily(spark, sf_dir).withColumns({"source": F.concat(F.lit("s"), (F.day("period") % 3).cast("string")), "unit": F.when(F.day("period") % 2 == 0, "bn")})
    return J.passed_metadata(d, ("signup", "view")).select("series", F.array_join("sources", ",").alias("sources"), F.array_join("units", ",").alias("units"), "alignment")


def scale_sample_ratios(spark, sf_dir):
    """The first twelve ratios of each field's edits by a thousand."""
    e = read(spark, sf_dir, "events").where("value > 0")
    after = F.when(F.col("event_id") % 3 == 0, F.col("value") * 1000.0).otherwise(F.col("value") * 1.5)
    edits = e.select("event_id", F.col("event_type").alias("field"), F.col("value").cast("string").alias("before"), after.cast("string").alias("after"))
    return X.scale_samples(edits, "event_id").select("field", "scale", F.size("ratios").cast("long").alias("n"), F.round(F.aggregate("ratios", F.lit(0.0), lambda a, x: a + x), 0).alias("total"))


def synonym_expansion(spark, sf_dir):
    p = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Den-LED Chieu_Sang "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("jewelry."), F.col("p_name"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", X.with_synonyms(p).alias("text"))


def embedded_json_props(spark, sf_dir):
    """Product facts from JSON that pages carry in scripts."""
    i = F.col("page_id").cast("string")
    script = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script type="application/ld+json"> {"@type": "Product", "sku": "p'), i, F.lit('"} </script>'))).when(F.col("page_id") % 3 == 1, '<script type="application/ld+json">{broken</script>').otherwise(F.concat(F.lit("<script>window.state = {\"sku\": {\"id\": "), i, F.lit("}};</script>")))
    page = F.concat(F.regexp_replace("html", "(?i)<script", "<noscript"), script)
    return read(spark, sf_dir, "pages").select("page_id", F.get_json_object(P.embedded_json(page), "$.sku").alias("sku"), F.get_json_object(P.embedded_json(page, "state"), "$.sku.id").cast("long").alias("state_id"))


def forecast_months(spark, sf_dir):
    """Every month's next six."""
    m = monthly(spark, sf_dir).select("series", "period").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return m.select("series", "period", F.col("step").cast("long").alias("step"), TR.month_after(F.col("period"), F.col("step")).alias("ahead"))


def holdout_rows(spark, sf_dir):
    """How many months each series trains and tests on, by fixed months."""
    out = TR.train_arima(monthly(spark, sf_dir), "series", train_end="2000-12", test_start="2001-01")
    return out.select("series", "status", F.col("n_train").cast("long").alias("n_train"), F.col("n_test").cast("long").alias("n_test"), "last_period")


def arima_exogenous(spark, sf_dir):
    """Forecasts of each series with last month's value of all series beside it."""
    total = monthly(spark, sf_dir).groupBy("period").agg(F.sum("value").alias("indigo")).withColumn("one", F.lit(1))
    lagged = W.lags(total, ["one"], "indigo", (1,)).select("period", "indigo_lag1")
    rows = monthly(spark, sf_dir).join(lagged, "period")
    return TR.forecast_from(TR.train_arima(rows, "series", ("indigo_lag1",), train_end="2000-12", test_start="2001-01"), "series", 6)


QUERIES = {f.__name__: f for f in (
    monitor_status, allowlist_order, enrichment_counts, seed_annual_reports, preferred_statement, last_twelve, latest_flag, reindexed_features, cleaned_macro, passed_series_metadata, scale_sample_ratios, synonym_expansion,
    embedded_json_props, forecast_months, holdout_rows, arima_exogenous,
)}
_NORMAL = r"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_PHRASES = " || ".join(f"CASE WHEN contains(replace(t, ' ', ''), '{k}') OR contains(t, '{k}') THEN ' {v}' ELSE '' END" for k, v in X.SYNONYMS)
SQL = {
    "monitor_status": "WITH j AS (SELECT value > 50 AS good FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT count(*) AS jobs_listed, count(*) FILTER (WHERE NOT coalesce(good, false)) AS jobs_failed FROM j",
    "allowlist_order": "SELECT upper(p_brand) AS code, min(p_partkey) AS place FROM part WHERE p_partkey % 9 > 0 GROUP BY 1",
    "enrichment_counts": "SELECT CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 2 THEN 'error' WHEN s_suppkey % 3 = 0 THEN 'live_ok' ELSE 'fallback' END AS status, count(*) AS n FROM supplier GROUP BY 1",
    "seed_annual_reports": f"""WITH {firms.REPORTS} SELECT company_id, period, report_type, revenue, 'http://live' AS source_url FROM reports WHERE NOT (company_id % 4 = 0 AND report_type = 'annual')
 UNION ALL SELECT s_suppkey, DATE '1999-12-31', 'annual', s_acctbal * 10, 'seed:companies.json' FROM supplier WHERE s_suppkey % 4 = 0""",
    "preferred_statement": f"WITH {firms.REPORTS}, r AS (SELECT company_id, period, revenue, company_id % 3 > 0 AND year(period) % 3 = 0 AS live FROM reports) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY live DESC, period DESC) = 1",
    "last_twelve": f"WITH {MONTHLY} SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY series ORDER BY period DESC) <= 12",
    "latest_flag": f"WITH {DAILY}, s AS (SELECT series, avg(value) AS m, 0.5::DOUBLE * nullif(stddev_pop(value), 0) AS d, max(period) AS last FROM daily GROUP BY 1) SELECT d.series, period, value FROM daily AS d JOIN s ON d.series = s.series AND period = last WHERE value < m - d OR value > m + d",
    "reindexed_features": f"WITH {MONTHLY}, t AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem), f AS (SELECT period, round(sum(value), 0) AS total FROM monthly GROUP BY 1) SELECT t.period, total FROM t LEFT JOIN f ON t.period = f.period",
    "cleaned_macro": f"""WITH {CLEAN} SELECT series, period, CASE WHEN series <> 'signup' THEN fill_kind WHEN value IS NULL THEN 'missing' ELSE 'observed' END AS fill_kind, is_outlier AND series <> 'signup' AS is_outlier,
 round(CASE WHEN series = 'signup' THEN value WHEN is_outlier THEN q2 ELSE filled END, 4) AS value_clean FROM marked""",
    "passed_series_metadata": f"WITH {DAILY} SELECT series, string_agg(DISTINCT 's' || day(period) % 3, ',' ORDER BY 's' || day(period) % 3) AS sources, coalesce(string_agg(DISTINCT CASE WHEN day(period) % 2 = 0 THEN 'bn' END, ','), '') AS units, 'quarterly_step_hold' AS alignment FROM daily WHERE series IN ('signup', 'view') GROUP BY 1",
    "scale_sample_ratios": "WITH e AS (SELECT event_type AS field, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE value > 0 AND event_id % 3 = 0) SELECT field, 'nghin' AS scale, count(*) AS n, count(*) * 1000.0::DOUBLE AS total FROM e WHERE r <= 12 GROUP BY 1",
    "synonym_expansion": f"WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Den-LED Chieu_Sang ' || p_name WHEN 1 THEN 'jewelry.' || p_name ELSE p_name END AS s FROM part), n AS (SELECT p_partkey, {_NORMAL.format(x='s')} AS t FROM s) SELECT p_partkey, trim(t || {_PHRASES}) AS text FROM n",
    "embedded_json_props": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id END AS sku, CASE WHEN page_id % 3 = 2 THEN page_id END AS state_id FROM pages",
    "forecast_months": f"WITH {MONTHLY} SELECT series, period, s AS step, CAST(period + to_months(CAST(s AS INTEGER)) AS DATE) AS ahead FROM monthly, range(1, 7) AS r(s)",
    "holdout_rows": f"WITH {MONTHLY} SELECT series, 'ok' AS status, count(*) FILTER (WHERE period < DATE '2001-01-01') AS n_train, count(*) FILTER (WHERE period >= DATE '2001-01-01') AS n_test, max(period) AS last_period FROM monthly GROUP BY 1",
}
