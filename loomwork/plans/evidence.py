"""Queries over shop evidence: candidates, gates, coverage, prefill, verification, registry views, hybrid scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import matching as M
from ..operators import tables as T
from . import firms
from .records import registry
from .series import read


def linked_pages(spark, sf_dir):
    p = F.col("page_id").cast("string")
    links = F.concat(F.lit('<a href="https://shopee.vn/Shop'), p, F.lit('.official">x</a> https://www.tiktok.com/@brand_'), p, F.lit(" https://shopee.vn/search?q=1 https://shopee.vn/shop"), p, F.lit(".official"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat("html", links).alias("html"))


def shop_link_candidates(spark, sf_dir):
    return D.shop_candidates(linked_pages(spark, sf_dir), "page_id", "html")


def gated_discovery(spark, sf_dir):
    c = D.shop_candidates(linked_pages(spark, sf_dir), "page_id", "html").select(F.col("page_id"), "handle", (F.col("page_id") % 10 / 10).alias("score"))
    allow = read(spark, sf_dir, "pages").where("page_id % 3 > 0").select("page_id")
    return D.gated(c, allow, ["page_id"], "score", 0.65).groupBy("verdict").agg(F.count("*").alias("n"))


def listing_coverage(spark, sf_dir):
    return D.listing_coverage(firms.firms(spark, sf_dir), firms.listings(spark, sf_dir)).withColumn("platforms", F.array_join("platforms", ","))


def benchmark_prefill(spark, sf_dir):
    r = firms.reports(spark, sf_dir).withColumn("employees", F.when(F.year("period") < 2000, F.col("employees")))
    return D.prefill(r).select("company_id", "period", "report_type", "revenue", "employees")


def website_verification(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    found = F.when(F.col("page_id") % 4 == 0, "http://elsewhere.example.org/").otherwise(F.regexp_replace("url", r"://(www\.|m\.)?", "://www."))
    checked = F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 7 > 0)
    return p.select("page_id", D.website_status(F.when(F.col("page_id") % 11 > 0, F.col("url")), checked, found).alias("status"))


def registry_latest_view(spark, sf_dir):
    r = registry(spark, sf_dir).withColumn("is_active", F.col("id") % 80 == 0)
    return D.registry_view(r).select("model_name", "id", "is_active")


def presence_audit_summary(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("flag"))
    u = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.lit("u").alias("url"))
    return D.audit_summary(T.audit(c, u, ["c_custkey"]))


def cleaning_report_counters(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    inner = lambda a, b: F.create_map(F.lit("filled"), a, F.lit("flagged"), b)
    nested = F.create_map(F.lit("iip"), inner(F.col("event_id") % 7, F.col("user_id") % 5), F.lit("peer"), inner(F.col("event_id") % 3, F.col("user_id") % 2))
    return D.report_counters(e.select("event_type", nested.alias("report")), "event_type", "report")


def renamed_ticker(spark, sf_dir):
    return D.renamed_key(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_name", "ASIA", "ASIA PACIFIC")


def hybrid_fusion(spark, sf_dir):
    """Fused scores of made-up fuzzy, vector and short-code scores."""
    e = read(spark, sf_dir, "events")
    f, v, c = (F.col("event_id") % 101) / 100, (F.col("user_id") % 11) / 10, F.when(F.col("event_id") % 3 == 0, 0.72).otherwise(0.0)
    return e.select("event_id", F.round(M.fused(f, v, c), 6).alias("score"))


def best_two_with_margin(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return D.best_of(p, ["p_brand"], "p_retailprice", "p_partkey").withColumn("margin", F.round("margin", 2))


def seed_before_discovery(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("channel"), "event_id", (F.col("event_id") % 13 == 0).alias("is_seed"))
    return D.first_by_priority(e, ["user_id", "channel"], F.desc("is_seed"), F.asc("event_id"))


QUERIES = {f.__name__: f for f in (shop_link_candidates, gated_discovery, listing_coverage, benchmark_prefill, website_verification, registry_latest_view, presence_audit_summary, cleaning_report_counters, renamed_ticker, hybrid_fusion, best_two_with_margin, seed_before_discovery)}
SQL = {
    "shop_link_candidates": """SELECT page_id, CAST(p AS BIGINT) AS place, CASE p WHEN 0 THEN 'shop' || page_id || '.official' ELSE 'brand_' || page_id END AS handle FROM pages, range(2) AS r(p)""",
    "gated_discovery": """WITH c AS (SELECT page_id, (page_id % 10) / 10 AS score FROM pages, range(2)) SELECT CASE WHEN page_id % 3 = 0 THEN 'not_allowed' WHEN score < 0.65 THEN 'below_threshold' ELSE 'accepted' END AS verdict, count(*) AS n FROM c GROUP BY 1""",
    "listing_coverage": f"""WITH {firms.LISTINGS}, c AS (SELECT company_id, count(*) AS n, count(coalesce(price * units_sold_est, revenue_est)) AS m, string_agg(DISTINCT lower(platform), ',' ORDER BY lower(platform)) AS p FROM listings WHERE lower(platform) IN ('shopee', 'tiktok', 'lazada') GROUP BY 1)
 SELECT f.company_id, coalesce(n, 0) AS n, coalesce(m, 0) AS n_with_revenue, p AS platforms, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN m < n THEN 'partial' ELSE 'full' END AS coverage FROM firms AS f LEFT JOIN c ON f.company_id = c.company_id""",
    "benchmark_prefill": f"""WITH {firms.REPORTS} SELECT company_id, period, report_type, revenue, employees FROM reports WHERE year(period) < 2000 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY report_type = 'annual' DESC, period DESC) = 1""",
    "website_verification": "SELECT page_id, CASE WHEN page_id % 11 = 0 OR page_id % 5 = 0 THEN 'unknown' WHEN page_id % 7 > 0 AND page_id % 4 > 0 THEN 'ok' ELSE 'fail' END AS status FROM pages",
    "registry_latest_view": """WITH r AS (SELECT event_type AS model_name, event_id AS id, event_id % 80 = 0 AS is_active FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id % 80 = 0 DESC, ts DESC, event_id DESC) = 1)
 SELECT * FROM r UNION ALL SELECT unnest(['arima', 'xgboost', 'lightgbm', 'lstm']), NULL, NULL""",
    "presence_audit_summary": "SELECT count(*) AS n, count(*) FILTER (WHERE (c_custkey % 3 = 0) = (c_custkey % 2 = 0)) AS n_ok, count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 2 > 0) AS n_flag_without_url, count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 2 = 0) AS n_url_without_flag FROM customer",
    "cleaning_report_counters": "SELECT event_type, 'filled' AS counter, CAST(sum(event_id % 7 + event_id % 3) AS BIGINT) AS total FROM events GROUP BY 1 UNION ALL SELECT event_type, 'flagged', CAST(sum(user_id % 5 + user_id % 2) AS BIGINT) FROM events GROUP BY 1",
    "renamed_ticker": "SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'ASIA PACIFIC' ELSE r_name END AS r_name FROM region",
    "hybrid_fusion": """WITH x AS (SELECT event_id, (event_id % 101) / 100 AS f, (user_id % 11) / 10 AS v, CASE WHEN event_id % 3 = 0 THEN 0.72::DOUBLE ELSE 0.0::DOUBLE END AS c FROM events)
 SELECT event_id, round(least(1, greatest(f, c, CASE WHEN f >= 0.6 AND v >= 0.45 THEN f + 0.5::DOUBLE * greatest(v - 0.4::DOUBLE, 0) ELSE 0 END, CASE WHEN f >= 0.35 AND v >= 0.55 THEN 0.35::DOUBLE * f + 0.65::DOUBLE * v ELSE 0 END, CASE WHEN c >= 0.7 AND v >= 0.3 THEN 0.55::DOUBLE * c + 0.45::DOUBLE * greatest(v, f) ELSE 0 END)), 6) AS score FROM x""",
    "best_two_with_margin": "WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER w AS place, round(p_retailprice - lead(p_retailprice) OVER w, 2) AS margin FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) SELECT * FROM r WHERE place <= 2",
    "seed_before_discovery": "SELECT user_id, event_type AS channel, event_id, event_id % 13 = 0 AS is_seed FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 13 = 0 DESC, event_id) = 1",
}
