"""Queries over firms: ratios, peer benchmarks, digital metrics, dashboards. Suppliers stand for firms, their lines for reports and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import metrics as M
from .series import added_in_order, read, read_in_pieces


def reports(spark, sf_dir):
    """(company_id, group_code, period, report_type, fields): a supplier's lines by year, annual for odd years."""
    ep, year = F.col("l_extendedprice"), F.year("l_shipdate")
    pieces = read_in_pieces(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_id"), year.alias("y"), "file", "start").agg(
        F.sum(ep).alias("revenue"), F.sum(ep * F.col("l_discount")).alias("profit"), F.sum(ep * F.col("l_tax")).alias("tax"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"),
    )
    sums = added_in_order(pieces, ["company_id", "y"], ["file", "start"]).withColumns({c: M.rounded(F.col(c), 2) for c in ("revenue", "profit", "tax")})
    firms = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("group_code"))
    gone = F.col("company_id") % 7 == 0
    return firms.join(sums, "company_id").select(
        "company_id", "group_code", F.make_date("y", F.lit(12), F.lit(31)).alias("period"), F.when(F.col("y") % 2 == 1, "annual").otherwise("quarterly").alias("report_type"),
        "revenue", F.col("profit").alias("profit_before_tax"), M.rounded(F.col("profit") - F.col("tax"), 2).alias("net_profit"), (F.col("quantity") * 1000).alias("total_assets"),
        F.when(F.col("company_id") % 11 == 0, 0.0).otherwise(F.col("quantity") * 400).alias("total_equity"), (F.col("quantity") * 300).alias("current_assets"), F.when(~gone, F.col("n") * 500.0).alias("current_liabilities"),
        F.col("tax").alias("operating_expenses"), M.rounded(F.col("tax") * 0.6, 2).alias("cost_of_goods"), F.when(~gone, M.rounded(F.col("tax") * 0.1, 2)).alias("rental_cost"),
        M.rounded(F.col("tax") * 0.2, 2).alias("remuneration"), F.col("n").alias("employees"),
    )


REPORTS = """sums AS (SELECT l_suppkey AS company_id, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * l_discount), 2) AS profit, round(sum(l_extendedprice * l_tax), 2) AS tax, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2),
 reports AS (SELECT company_id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS group_code, make_date(y, 12, 31) AS period, CASE WHEN y % 2 = 1 THEN 'annual' ELSE 'quarterly' END AS report_type, revenue, profit AS profit_before_tax, round(profit - tax, 2) AS net_profit,
   quantity * 1000 AS total_assets, CASE WHEN company_id % 11 = 0 THEN 0 ELSE quantity * 400 END AS total_equity, quantity * 300 AS current_assets, CASE WHEN company_id % 7 <> 0 THEN n * 500.0::DOUBLE END AS current_liabilities, tax AS operating_expenses,
   round(tax * 0.6::DOUBLE, 2) AS cost_of_goods, CASE WHEN company_id % 7 <> 0 THEN round(tax * 0.1::DOUBLE, 2) END AS rental_cost, round(tax * 0.2::DOUBLE, 2) AS remuneration, n AS employees FROM sums JOIN supplier ON s_suppkey = company_id),
 latest AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY report_type = 'annual' DESC, period DESC) = 1)"""
SQL_RATIOS = {n: f"{a} / nullif({b}, 0)" for n, (a, b) in M.RATIOS.items()} | {"debt_to_equity": "(total_assets - total_equity) / nullif(total_equity, 0)"}
LONG = REPORTS + ", long AS (" + " UNION ALL ".join(f"SELECT company_id, group_code, '{n}' AS metric, {x} AS value FROM latest" for n, x in SQL_RATIOS.items()) + "), pop AS (SELECT * FROM long WHERE value IS NOT NULL)"
STATS = LONG + """, stats AS (SELECT group_code, metric, count(*) AS peers, round(avg(value), 4) AS average, CASE WHEN count(*) >= 4 THEN round(quantile_cont(value, 0.25), 6) END AS p25,
 CASE WHEN count(*) >= 4 THEN round(quantile_cont(value, 0.5), 6) END AS p50, CASE WHEN count(*) >= 4 THEN round(quantile_cont(value, 0.75), 6) END AS p75 FROM pop GROUP BY 1, 2)"""
LABEL = "CASE WHEN {p} = 0 THEN 'insufficient_peers' WHEN {v} > {a} * 1.1::DOUBLE THEN 'above_average' WHEN {v} < {a} * 0.9::DOUBLE THEN 'below_average' ELSE 'average' END"


def safe_ratios_13(spark, sf_dir):
    r = M.benchmark_ratios(reports(spark, sf_dir))
    return r.select("company_id", "period", *(M.rounded(F.col(m), 6).alias(m) for m in M.METRICS))


def feature_ratios(spark, sf_dir):
    return M.feature_ratios(reports(spark, sf_dir)).select("company_id", "period", *(M.rounded(F.col(m), 6).alias(m) for m in ("roa", "roe", "current_ratio")))


def latest_report(spark, sf_dir):
    return B.latest_reports(reports(spark, sf_dir)).select("company_id", "period", "report_type", "revenue")


def latest(spark, sf_dir):
    return B.latest_reports(reports(spark, sf_dir))


def peer_quartiles(spark, sf_dir):
    return B.statistics(B.long_ratios(latest(spark, sf_dir), ["company_id", "group_code"]), ["group_code", "metric"])


def peer_percentile(spark, sf_dir):
    return B.percentiles(B.long_ratios(latest(spark, sf_dir), ["company_id", "group_code"]), ["group_code", "metric"]).select("company_id", "metric", "percentile")


def benchmark_full(spark, sf_dir):
    rows = B.compare(latest(spark, sf_dir), latest(spark, sf_dir), "group_code")
    return rows.withColumn("value", M.rounded(F.col("value"), 6)).withColumn("warnings", F.array_join("warnings", ","))


def digital_peer_excluding_self(spark, sf_dir):
    rows = B.compare(latest(spark, sf_dir), latest(spark, sf_dir), "group_code", metrics=("profit_margin", "asset_turnover"), exclude_self=True)
    return rows.select("company_id", "group_code", "metric", M.rounded(F.col("value"), 6).alias("value"), "peers", "average", "percentile")


def extract_consistency(spark, sf_dir):
    stored = latest(spark, sf_dir)
    off = F.when(F.col("company_id") % 3 == 0, 1.2).when(F.col("company_id") % 3 == 1, 1.05).otherwise(1.0)
    got = stored.select("company_id", M.rounded(F.col("revenue") * off, 2).alias("operating_revenue"), F.col("profit_before_tax"), F.col("total_assets"), F.col("total_equity"), F.when(F.col("company_id") % 5 > 0, F.col("employees")).alias("employees"))
    return B.consistency(got, stored, "company_id").select("company_id", "field", M.rounded(F.col("deviation"), 6).alias("deviation"), "severity", "note")


CHANNELS = "CASE event_type WHEN 'click' THEN 'shopee' WHEN 'view' THEN 'website' WHEN 'purchase' THEN 'tiktok' WHEN 'signup' THEN 'lazada' ELSE 'forum' END"


def presence(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("company_id"), F.expr(CHANNELS).alias("channel_type"), (F.col("event_id") % 4 > 0).alias("is_active"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 100 / 100).alias("match_confidence"))


def users(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("company_id")).distinct().withColumn("has_ecommerce_site", F.col("company_id") % 3 == 0)


PRESENCE = f"presence AS (SELECT user_id AS company_id, {CHANNELS} AS channel_type, event_id % 4 > 0 AS is_active, CASE WHEN event_id % 5 > 0 THEN (event_id % 100) / 100 END AS match_confidence FROM events), users AS (SELECT DISTINCT user_id AS company_id, user_id % 3 = 0 AS has_ecommerce_site FROM events)"


def adoption_diversity(spark, sf_dir):
    return M.adoption(presence(spark, sf_dir), users(spark, sf_dir))


#: One firm in ten sells nothing itself: its neighbour does.
SELLER = "l_suppkey + CASE WHEN l_suppkey % 10 = 4 THEN 1 ELSE 0 END"


def listings(spark, sf_dir):
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        F.expr(SELLER).alias("company_id"), F.when(n % 4 == 1, "Shopee").when(n % 4 == 2, "tiktok").when(n % 4 == 3, "lazada").otherwise("website").alias("platform"),
        F.when(F.col("l_orderkey") % 3 > 0, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_quantity").cast("int")).alias("units_sold_est"),
        F.when(F.col("l_orderkey") % 2 > 0, F.round(F.col("l_extendedprice") * 2, 2)).alias("revenue_est"),
    )


def firms(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") * 1000).alias("revenue"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("vsic_code"))


LISTINGS = f"""listings AS (SELECT {SELLER} AS company_id, CASE l_linenumber % 4 WHEN 1 THEN 'Shopee' WHEN 2 THEN 'tiktok' WHEN 3 THEN 'lazada' ELSE 'website' END AS platform, CASE WHEN l_orderkey % 3 > 0 THEN l_extendedprice END AS price,
   CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_quantity AS INTEGER) END AS units_sold_est, CASE WHEN l_orderkey % 2 > 0 THEN round(l_extendedprice * 2, 2) END AS revenue_est FROM lineitem),
 firms AS (SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal * 1000 END AS revenue, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS vsic_code FROM supplier),
 sums AS (SELECT company_id, sum(coalesce(price * units_sold_est, revenue_est)) AS s, count(coalesce(price * units_sold_est, revenue_est)) AS n FROM listings WHERE lower(platform) IN ('shopee', 'tiktok', 'lazada') GROUP BY 1),
 online AS (SELECT f.*, CASE WHEN n > 0 THEN s WHEN revenue > 0 THEN revenue * 0.02::DOUBLE ELSE 0 END AS online_revenue, CASE WHEN n > 0 THEN 'listings' WHEN revenue > 0 THEN 'industry_ratio' ELSE 'missing' END AS basis FROM firms AS f LEFT JOIN sums ON f.company_id = sums.company_id),
 va AS (SELECT *, round(online_revenue * coalesce(CASE WHEN company_id % 3 > 0 THEN 0.3::DOUBLE END, 0.25::DOUBLE) + online_revenue * 0.05::DOUBLE * ((company_id % 10) / 10) - online_revenue * 0.02::DOUBLE, 2) AS va FROM online)"""


def online(spark, sf_dir):
    return M.online_revenue(listings(spark, sf_dir), firms(spark, sf_dir), industry_ratio=0.02)


def online_revenue_fallback(spark, sf_dir):
    return online(spark, sf_dir).select("company_id", F.round("online_revenue", 2).alias("online_revenue"), "basis")


def with_va(spark, sf_dir):
    margin, score = F.when(F.col("company_id") % 3 > 0, 0.3), F.col("company_id") % 10 / 10
    return online(spark, sf_dir).withColumn("va", F.round(M.value_added(F.col("online_revenue"), margin, score), 2))


def value_added(spark, sf_dir):
    return with_va(spark, sf_dir).select("company_id", "va")


def industry_share(spark, sf_dir):
    return M.industry_share(with_va(spark, sf_dir), "vsic_code", "va").select("company_id", "industry_share_pct")


def contributors_share(spark, sf_dir):
    return M.contributors(with_va(spark, sf_dir), "va").select("company_id", "va", "share_pct")


def data_quality_score(spark, sf_dir):
    f = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.when(F.col("s_suppkey") % 6 == 0, "http://firm").alias("website_url"))
    ls = listings(spark, sf_dir).withColumn("platform", F.lower("platform"))
    metrics = f.where("company_id % 8 > 0").select("company_id", F.when(F.col("company_id") % 8 > 2, 1.0).alias("online_revenue_est"))
    rows = M.data_quality(presence(spark, sf_dir), ls, metrics, f)
    return rows.drop("website_url")


def kpi_summary(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.round(F.avg("o_totalprice"), 2).alias("mean_value"), F.round(F.sum("o_totalprice"), 0).alias("total_value"), F.max(F.to_date("o_orderdate")).alias("last_day"))


def peer_list_limit(spark, sf_dir):
    """Up to 12 peers of each firm of one nation: those with the largest balances."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    top = s.withColumn("place", rank).where("place <= 13").select("s_nationkey", F.col("s_suppkey").alias("peer"), "place")  # one more than 12: a firm is not its own peer
    pairs = s.select("s_suppkey", "s_nationkey").join(top, "s_nationkey").where("s_suppkey <> peer")
    return pairs.withColumn("peer_rank", F.row_number().over(Window.partitionBy("s_suppkey").orderBy("place")).cast("long")).where("peer_rank <= 12").select("s_suppkey", "peer", "peer_rank")


def company_nested_detail(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    rows = M.nested(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey", "orders", "o_orderkey", "o_orderstatus")
    return rows.select("c_custkey", "c_name", F.size("orders").cast("long").alias("n_orders"), F.array_join(F.transform("orders", lambda x: F.concat(x.o_orderkey.cast("string"), F.lit(":"), x.o_orderstatus)), ",").alias("orders"))


def timeline_union(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.col("ts").alias("at"), F.lit("event").alias("kind"), F.col("event_type").alias("label"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("label"))
    return e.unionByName(o).orderBy(F.desc_nulls_last("at"), "company_id", "kind", "label")


def aligned_series(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    ls = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("period")).agg(F.sum("l_quantity").alias("value"))
    return M.aligned(o, ls, ("orders_last", "lines_last"))


def metric_coverage(spark, sf_dir):
    v = with_va(spark, sf_dir)
    top = v.orderBy(F.desc("va"), "company_id").limit(3).agg(F.sum("va").alias("top"))
    return v.agg(F.count("*").alias("n"), F.count_if(F.col("va") > 0).alias("n_with_va"), F.sum("va").alias("total")).join(F.broadcast(top)).select("n", "n_with_va", F.round(F.col("n_with_va") / F.col("n") * 100, 1).alias("coverage_pct"), F.round(F.col("top") / F.col("total") * 100, 2).alias("top3_share_pct"))


QUERIES = {f.__name__: f for f in (
    safe_ratios_13, feature_ratios, latest_report, peer_quartiles, peer_percentile, benchmark_full, digital_peer_excluding_self, extract_consistency, adoption_diversity, online_revenue_fallback,
    value_added, industry_share, contributors_share, data_quality_score, kpi_summary, peer_list_limit, company_nested_detail, timeline_union, aligned_series, metric_coverage,
)}
WEIGHT = "CASE channel_type WHEN 'website' THEN 0.35::DOUBLE WHEN 'shopee' THEN 0.30::DOUBLE WHEN 'tiktok' THEN 0.20::DOUBLE WHEN 'lazada' THEN 0.15::DOUBLE ELSE 0::DOUBLE END"
SQL = {
    "safe_ratios_13": f"WITH {REPORTS} SELECT company_id, period, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in SQL_RATIOS.items()) + " FROM reports",
    "feature_ratios": f"WITH {REPORTS} SELECT company_id, period, round(net_profit / nullif(total_assets, 0), 6) AS roa, round(net_profit / nullif(total_equity, 0), 6) AS roe, round(current_assets / nullif(current_liabilities, 0), 6) AS current_ratio FROM reports",
    "latest_report": f"WITH {REPORTS} SELECT company_id, period, report_type, revenue FROM latest",
    "peer_quartiles": f"WITH {STATS} SELECT * FROM stats",
    "peer_percentile": f"WITH {LONG} SELECT company_id, metric, round(cume_dist() OVER (PARTITION BY group_code, metric ORDER BY value) * 100, 1) AS percentile FROM pop",
    "benchmark_full": f"""WITH {STATS}, t AS (SELECT l.*, coalesce(s.peers, 0) AS peers, average, p25, p50, p75, (SELECT count(*) FROM pop WHERE pop.group_code = l.group_code AND pop.metric = l.metric AND pop.value <= l.value) AS le
   FROM long AS l LEFT JOIN stats AS s ON l.group_code = s.group_code AND l.metric = s.metric)
 SELECT company_id, group_code, metric, round(value, 6) AS value, peers, average, p25, p50, p75, CASE WHEN value IS NOT NULL THEN round(le / nullif(peers, 0) * 100, 1) END AS percentile, CASE WHEN value IS NOT NULL THEN {LABEL.format(p='peers', v='value', a='average')} END AS label,
   CASE WHEN peers = 0 THEN 'insufficient_peers,small_peer_sample' WHEN peers < 3 THEN 'prototype_listed_sample,small_peer_sample' ELSE 'prototype_listed_sample' END AS warnings FROM t""",
    "digital_peer_excluding_self": f"""WITH {LONG}, l AS (SELECT * FROM long WHERE metric IN ('profit_margin', 'asset_turnover')), o AS (SELECT a.company_id, a.group_code, a.metric, a.value, count(b.value) AS peers, avg(b.value) AS average, count(*) FILTER (WHERE b.value <= a.value) AS le
   FROM l AS a LEFT JOIN pop AS b ON a.group_code = b.group_code AND a.metric = b.metric AND a.company_id <> b.company_id GROUP BY 1, 2, 3, 4)
 SELECT company_id, group_code, metric, round(value, 6) AS value, peers, round(average, 4) AS average, CASE WHEN value IS NOT NULL THEN round(le / nullif(peers, 0) * 100, 1) END AS percentile FROM o""",
    "extract_consistency": f"""WITH {REPORTS}, x AS (SELECT company_id, unnest([
   {{'field': 'operating_revenue', 'e': round(revenue * CASE company_id % 3 WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 1.05::DOUBLE ELSE 1::DOUBLE END, 2), 's': revenue}}, {{'field': 'profit_before_tax', 'e': profit_before_tax, 's': profit_before_tax}},
   {{'field': 'total_assets', 'e': total_assets, 's': total_assets}}, {{'field': 'total_equity', 'e': total_equity, 's': total_equity}}, {{'field': 'employees', 'e': CASE WHEN company_id % 5 > 0 THEN CAST(employees AS DOUBLE) END, 's': CAST(employees AS DOUBLE)}}]) AS f FROM latest),
 y AS (SELECT company_id, f.field AS field, f.e AS e, f.s AS s, abs(f.e - f.s) / nullif(abs(f.s), 0) AS d FROM x)
 SELECT company_id, field, round(d, 6) AS deviation, CASE WHEN e IS NULL OR s IS NULL THEN 'warn' WHEN s = 0 AND e = 0 THEN 'ok' WHEN s = 0 THEN 'mismatch' WHEN d < 0.1 THEN 'ok' ELSE 'mismatch' END AS severity,
   CASE WHEN e IS NULL OR s IS NULL THEN 'missing' WHEN s = 0 AND e <> 0 THEN 'zero_db' END AS note FROM y""",
    "adoption_diversity": f"""WITH {PRESENCE}, c AS (SELECT DISTINCT company_id, channel_type FROM presence WHERE is_active AND (channel_type NOT IN ('shopee', 'tiktok', 'lazada') OR match_confidence IS NULL OR match_confidence >= 0.65)),
 s AS (SELECT company_id, sum({WEIGHT}) AS w, count(*) AS n FROM c GROUP BY 1)
 SELECT u.company_id, has_ecommerce_site, round(least(coalesce(w, 0) + CASE WHEN has_ecommerce_site THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1), 3) AS adoption, round(coalesce(n, 0) / 4, 3) AS diversity FROM users AS u LEFT JOIN s ON u.company_id = s.company_id""",
    "online_revenue_fallback": f"WITH {LISTINGS} SELECT company_id, round(online_revenue, 2) AS online_revenue, basis FROM online",
    "value_added": f"WITH {LISTINGS} SELECT company_id, va FROM va",
    "industry_share": f"WITH {LISTINGS} SELECT company_id, round(coalesce(va / nullif(sum(va) OVER (PARTITION BY vsic_code), 0), 0) * 100, 2) AS industry_share_pct FROM va",
    "contributors_share": f"WITH {LISTINGS} SELECT company_id, va, round(va / nullif(sum(va) OVER (), 0) * 100, 2) AS share_pct FROM va WHERE va > 0",
    "data_quality_score": f"""WITH {PRESENCE}, {LISTINGS}, p AS (SELECT company_id, bool_or(channel_type = 'website' AND is_active) AS site, bool_or(channel_type IN ('shopee', 'tiktok', 'lazada') AND is_active) AS market, avg(CASE WHEN is_active THEN match_confidence END) AS c FROM presence GROUP BY 1),
 l AS (SELECT company_id, count(*) FILTER (WHERE (price IS NOT NULL AND units_sold_est IS NOT NULL) OR revenue_est IS NOT NULL) / count(*) AS r FROM listings WHERE lower(platform) IN ('shopee', 'tiktok', 'lazada') GROUP BY 1),
 c AS (SELECT s_suppkey AS company_id, CASE WHEN coalesce(site, false) OR s_suppkey % 6 = 0 THEN 20.0::DOUBLE ELSE 0::DOUBLE END AS website_presence, CASE WHEN coalesce(market, false) THEN 20.0::DOUBLE ELSE 0::DOUBLE END AS marketplace_channel, round(coalesce(c, 0) * 25, 2) AS match_confidence,
   round(coalesce(r, 0) * 20, 2) AS listing_completeness, CASE WHEN s_suppkey % 8 > 2 THEN 15.0::DOUBLE ELSE 0::DOUBLE END AS digital_metrics FROM supplier LEFT JOIN p ON p.company_id = s_suppkey LEFT JOIN l ON l.company_id = s_suppkey),
 t AS (SELECT *, round(website_presence + marketplace_channel + match_confidence + listing_completeness + digital_metrics, 2) AS score FROM c)
 SELECT *, CASE WHEN score >= 70 THEN 'ok' WHEN score >= 35 THEN 'partial' ELSE 'sparse' END AS status FROM t""",
    "kpi_summary": "SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, round(avg(o_totalprice), 2) AS mean_value, round(sum(o_totalprice), 0) AS total_value, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders",
    "peer_list_limit": """WITH p AS (SELECT a.s_suppkey, b.s_suppkey AS peer, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_acctbal DESC, b.s_suppkey) AS peer_rank FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) SELECT * FROM p WHERE peer_rank <= 12""",
    "company_nested_detail": """SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
    "timeline_union": """SELECT user_id AS company_id, ts AS "at", 'event' AS kind, event_type AS label FROM events UNION ALL SELECT o_custkey, o_orderdate, 'order', o_orderpriority FROM orders""",
    "aligned_series": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS p, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
 a AS (SELECT strftime(p, '%Y-%m') AS month, max_by(v, p) AS orders_last FROM o GROUP BY 1), b AS (SELECT strftime(p, '%Y-%m') AS month, max_by(v, p) AS lines_last FROM l GROUP BY 1)
 SELECT coalesce(a.month, b.month) AS month, orders_last, lines_last FROM a FULL JOIN b ON a.month = b.month""",
    "metric_coverage": f"""WITH {LISTINGS}, r AS (SELECT va, row_number() OVER (ORDER BY va DESC, company_id) AS n FROM va) SELECT count(*) AS n, count(*) FILTER (WHERE va > 0) AS n_with_va, round(count(*) FILTER (WHERE va > 0) / count(*) * 100, 1) AS coverage_pct, round(sum(va) FILTER (WHERE n <= 3) / sum(va) * 100, 2) AS top3_share_pct FROM r""",
}
