"""Firm metrics: safe ratios, online revenue, digital adoption and value added, shares, data quality, dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name

#: Marketplaces, channel weights, the confidence a marketplace channel needs, and value-added rates.
PLATFORMS = ("shopee", "tiktok", "lazada")
WEIGHTS = {"website": 0.35, "shopee": 0.30, "tiktok": 0.20, "lazada": 0.15}
LEAST_CONFIDENCE = 0.65
DEFAULT_MARGIN, SAVINGS, INVESTMENT = 0.25, 0.05, 0.02
#: Numerator and denominator of the benchmark ratios. Returns here are before tax.
RATIOS = {
    "roa": ("profit_before_tax", "total_assets"),
    "roe": ("profit_before_tax", "total_equity"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "equity_ratio": ("total_equity", "total_assets"),
    "revenue_per_worker": ("revenue", "employees"),
    "profit_per_worker": ("profit_before_tax", "employees"),
    "profit_margin": ("profit_before_tax", "revenue"),
    "asset_turnover": ("revenue", "total_assets"),
    "expenditure_related_ratio": ("operating_expenses", "revenue"),
    "purchase_goods_share": ("cost_of_goods", "operating_expenses"),
    "rental_cost_share": ("rental_cost", "operating_expenses"),
    "remuneration_share": ("remuneration", "operating_expenses"),
}
METRICS = (*RATIOS, "debt_to_equity")
HIGHER_IS_WORSE = ("debt_to_equity",)


def ratio(a: str | Column, b: str | Column) -> Column:
    """Null if either side is null or the denominator is 0."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def rounded(value: Column, digits: int) -> Column:
    """``value`` to ``digits`` places by its scaled double, as SQL engines round doubles.

    ``F.round`` takes a double's shortest decimal instead, so that ties such as 1.005 would go another way than in SQL.
    """
    return F.round(value * float(10**digits)) / float(10**digits)


def benchmark_ratios(reports: DataFrame) -> DataFrame:
    """``reports`` with the 13 benchmark ratios; fields that a table lacks count as null."""
    has = set(reports.columns)
    field = lambda c: F.col(c).cast("double") if c in has else F.lit(None).cast("double")
    out = {name: ratio(field(a), field(b)) for name, (a, b) in RATIOS.items()}
    out["debt_to_equity"] = ratio(field("total_assets") - field("total_equity"), field("total_equity"))
    return reports.withColumns(out)


def feature_ratios(reports: DataFrame) -> DataFrame:
    """The three ratios of the feature frame. Returns here are after tax."""
    return reports.withColumns({"roa": ratio("net_profit", "total_assets"), "roe": ratio("net_profit", "total_equity"), "current_ratio": ratio("current_assets", "current_liabilities")})


def division(code: str | Column) -> Column:
    """The first two characters of a classification code."""
    return F.substring(F.col(code) if isinstance(code, str) else code, 1, 2)


def listing_revenue() -> Column:
    """Price times units where both are there, else the estimate."""
    return F.coalesce(F.col("price") * F.col("units_sold_est"), F.col("revenue_est"))


def online_revenue(listings: DataFrame, firms: DataFrame, industry_ratio: float | None = None) -> DataFrame:
    """``firms`` (company_id, revenue) with ``online_revenue`` and its basis: listings, else ratio times revenue, else 0."""
    total, n = free_name("listed_sum", *firms.columns), free_name("listed_n", *firms.columns)
    sums = listings.where(F.lower("platform").isin(*PLATFORMS)).select("company_id", listing_revenue().alias("c")).groupBy("company_id").agg(F.sum("c").alias(total), F.count("c").alias(n))
    joined = firms.join(sums, "company_id", "left")
    by_ratio = (F.col("revenue") > 0) & F.lit(industry_ratio is not None)
    basis = F.when(F.col(n) > 0, "listings").when(by_ratio, "industry_ratio").otherwise("missing")
    value = F.when(F.col(n) > 0, F.col(total)).when(by_ratio, F.col("revenue") * F.lit(industry_ratio)).otherwise(0.0)
    return joined.withColumns({"online_revenue": value, "basis": basis}).drop(total, n)


def verified_channels(presence: DataFrame) -> DataFrame:
    """Active channels, of marketplaces only those whose match confidence is unknown or high enough."""
    sure = ~F.col("channel_type").isin(*PLATFORMS) | F.col("match_confidence").isNull() | (F.col("match_confidence") >= LEAST_CONFIDENCE)
    return presence.where(F.col("is_active") & sure)


def adoption(presence: DataFrame, firms: DataFrame) -> DataFrame:
    """``firms`` (company_id, has_ecommerce_site) with ``adoption`` and ``diversity`` of their verified channels."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("channel_type"))
    total, n = free_name("channel_weight", *firms.columns), free_name("channel_n", *firms.columns)
    channels = verified_channels(presence).select("company_id", "channel_type").distinct().groupBy("company_id").agg(F.sum(F.coalesce(weight, F.lit(0.0))).alias(total), F.count("*").alias(n))
    joined = firms.join(channels, "company_id", "left")
    score = F.coalesce(total, F.lit(0.0)) + F.when(F.col("has_ecommerce_site"), 0.1).otherwise(0.0)
    return joined.withColumns({"adoption": F.round(F.least(score, F.lit(1.0)), 3), "diversity": F.round(F.coalesce(n, F.lit(0)) / 4.0, 3)}).drop(total, n)


def value_added(revenue: Column, margin: Column, score: Column) -> Column:
    return revenue * F.coalesce(margin, F.lit(DEFAULT_MARGIN)) + revenue * SAVINGS * score - revenue * INVESTMENT


def industry_share(firms: DataFrame, code: str, value: str) -> DataFrame:
    """``industry_share_pct`` of a firm in its division's sum; 0 where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(division(code)))
    return firms.withColumn("industry_share_pct", F.round(F.coalesce(ratio(F.col(value), total), F.lit(0.0)) * 100, 2))


def contributors(firms: DataFrame, value: str) -> DataFrame:
    """Firms with a positive value and their share of the result's total, largest first."""
    rows = firms.where(F.col(value) > 0)
    total = rows.agg(F.sum(value).alias("__total"))
    return rows.join(F.broadcast(total)).withColumn("share_pct", F.round(ratio(value, "__total") * 100, 2)).drop("__total")


def data_quality(presence: DataFrame, listings: DataFrame, metrics: DataFrame, firms: DataFrame) -> DataFrame:
    """Completeness of each firm's evidence: five components, their sum and its status."""
    on = F.col("is_active")
    p = presence.groupBy("company_id").agg(
        F.bool_or((F.col("channel_type") == "website") & on).alias("__site"), F.bool_or(F.col("channel_type").isin(*PLATFORMS) & on).alias("__market"),
        F.avg(F.when(on, F.col("match_confidence"))).alias("__confidence"),
    )
    complete = (F.col("price").isNotNull() & F.col("units_sold_est").isNotNull()) | F.col("revenue_est").isNotNull()
    ls = listings.where(F.col("platform").isin(*PLATFORMS)).groupBy("company_id").agg((F.count_if(complete) / F.count("*")).alias("__complete"))
    m = metrics.groupBy("company_id").agg((F.count("online_revenue_est") > 0).alias("__metric"))
    rows = firms.join(p, "company_id", "left").join(ls, "company_id", "left").join(m, "company_id", "left")
    yes = lambda c, points: F.when(c, points).otherwise(0.0)
    parts = {
        "website_presence": yes(F.coalesce("__site", F.lit(False)) | F.coalesce(F.length("website_url") > 0, F.lit(False)), 20.0),
        "marketplace_channel": yes(F.coalesce("__market", F.lit(False)), 20.0),
        "match_confidence": F.round(F.coalesce("__confidence", F.lit(0.0)) * 25, 2),
        "listing_completeness": F.round(F.coalesce("__complete", F.lit(0.0)) * 20, 2),
        "digital_metrics": yes(F.coalesce("__metric", F.lit(False)), 15.0),
    }
    rows = rows.withColumns(parts).drop("__site", "__market", "__confidence", "__complete", "__metric")
    rows = rows.withColumn("score", F.round(sum((F.col(c) for c in parts), F.lit(0.0)), 2))
    return rows.withColumn("status", F.when(F.col("score") >= 70, "ok").when(F.col("score") >= 35, "partial").otherwise("sparse"))


def aligned(left: DataFrame, right: DataFrame, names: tuple[str, str], period: str = "period", value: str = "value") -> DataFrame:
    """Two monthly series side by side by month, missing sides null; of several rows in a month the last one counts."""
    side = lambda df, n: df.groupBy(F.date_format(period, "yyyy-MM").alias("month")).agg(F.max_by(value, period).alias(n))
    return side(left, names[0]).join(side(right, names[1]), "month", "full")


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    """``parents`` with an array of their children's structs, sorted; an empty array without any."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(name, F.expr(f"slice({name}, 1, 0)"), F.array()))
