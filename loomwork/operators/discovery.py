"""Shop discovery and evidence reports: candidates from pages, gates, coverage, prefill, verification, registry views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .metrics import PLATFORMS, listing_revenue
from .shared import free_name
from .tables import MODELS
from .windows import latest

#: Shop links of two marketplaces in a page, and paths that are no shops.
SHOP_LINK = r"(?i)https?://(?:www\.)?(?:shopee\.vn/|tiktok\.com/@)([A-Za-z0-9._]{3,})"
NO_SHOP = ("search", "product", "buyer", "cart", "mall", "help", "login", "shop")
REQUIRED = ("revenue", "profit_before_tax", "total_assets", "total_equity")


def shop_candidates(pages: DataFrame, key: str, html: str, most: int = 20) -> DataFrame:
    """(key, handle, place): distinct shop handles of each page in order of appearance, noise left out, ``most`` at most."""
    handles = F.regexp_extract_all(F.col(html), F.lit(SHOP_LINK), F.lit(1))
    clean = F.filter(F.array_distinct(F.transform(handles, lambda h: F.regexp_replace(F.lower(h), r"[.]+$", ""))), lambda h: ~h.isin(*NO_SHOP))
    return pages.select(key, F.posexplode(F.slice(clean, 1, most)).alias("place", "handle")).withColumn("place", F.col("place").cast("long"))


def gated(candidates: DataFrame, allow: DataFrame, keys: list[str], score: str, threshold: float, enabled: bool = True) -> DataFrame:
    """Candidates with ``verdict``: accepted only where discovery is on, the pair is on the allow-list and the score is enough."""
    listed = free_name("listed", *candidates.columns)
    marked = candidates.join(allow.select(*keys).distinct().withColumn(listed, F.lit(True)), keys, "left")
    verdict = F.when(F.lit(not enabled), "disabled").when(F.col(listed).isNull(), "not_allowed").when(F.coalesce(F.col(score), F.lit(0.0)) < threshold, "below_threshold").otherwise("accepted")
    return marked.withColumn("verdict", verdict).drop(listed)


def first_by_priority(rows: DataFrame, keys: list[str], *priority: Column) -> DataFrame:
    """One row for each key, the first by priority: a seed's link goes before a discovered one."""
    return latest(rows, keys, *priority)


def listing_coverage(firms: DataFrame, listings: DataFrame, key: str = "company_id") -> DataFrame:
    """Listings of each firm on marketplaces, how many give a revenue, their sources, and whether there is enough."""
    rows = listings.where(F.lower("platform").isin(*PLATFORMS))
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.count(listing_revenue()).alias("n_with_revenue"), F.array_sort(F.collect_set(F.lower("platform"))).alias("platforms"))
    out = firms.select(key).distinct().join(counted, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_with_revenue": F.coalesce("n_with_revenue", F.lit(0))})
    return out.withColumn("coverage", F.when(F.col("n") == 0, "none").when(F.col("n_with_revenue") < F.col("n"), "partial").otherwise("full"))


def prefill(reports: DataFrame, key: str = "company_id") -> DataFrame:
    """The latest report of each firm that has all required fields and workers, annual ones first."""
    whole = reports.where(" AND ".join(f"{c} IS NOT NULL" for c in (*REQUIRED, "employees")))
    annual = F.lower("report_type") == "annual"
    return latest(whole, [key], F.desc(F.coalesce(annual, F.lit(False))), F.desc("period"))


def website_status(url: Column, checked: Column, found: Column) -> Column:
    """ok, fail or unknown: whether a check reached the host that a profile names."""
    same = X.host(url) == X.host(found)
    return F.when(url.isNull() | (url == ""), "unknown").when(checked.isNull(), "unknown").when(checked & same, "ok").otherwise("fail")


def registry_view(registry: DataFrame) -> DataFrame:
    """The row of each model to show: an active one first, then the newest; known models without a row are listed too."""
    spark = registry.sparkSession
    rows = latest(registry, ["model_name"], F.desc("is_active"), F.desc("trained_at"), F.desc("id"))
    names = spark.createDataFrame([(n, i) for i, n in enumerate(MODELS)], "model_name string, place int")
    return names.join(rows, "model_name", "full").withColumn("place", F.coalesce("place", F.lit(len(MODELS)))).orderBy("place", "model_name")


def report_counters(reports: DataFrame, key: str, fields: str) -> DataFrame:
    """Sums of a nested report's counters (map of series to map of counter to number), by counter."""
    inner = F.explode(F.map_entries(F.col(fields)))
    flat = reports.select(key, inner.alias("s")).select(key, F.explode(F.map_entries(F.col("s.value"))).alias("c"))
    return flat.groupBy(key, F.col("c.key").alias("counter")).agg(F.sum("c.value").alias("total"))


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("n"), F.count_if(F.col("mismatch").isNull()).alias("n_ok"), F.count_if(F.col("mismatch") == "flag_without_url").alias("n_flag_without_url"), F.count_if(F.col("mismatch") == "url_without_flag").alias("n_url_without_flag"))


def renamed_key(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """``old`` renamed to ``new`` unless the table has ``new`` already."""
    there = free_name("there", *rows.columns)
    has = rows.agg(F.coalesce(F.bool_or(F.col(key) == new), F.lit(False)).alias(there))  # one row
    return rows.join(F.broadcast(has), F.lit(True)).withColumn(key, F.when((F.col(key) == old) & ~F.col(there), new).otherwise(F.col(key))).drop(there)


def top_share(rows: DataFrame, value: str, n: int = 3) -> DataFrame:
    """Share of the ``n`` largest values in the sum of all."""
    top = rows.orderBy(F.desc_nulls_last(value)).limit(n).agg(F.sum(value).alias("top"))
    return rows.agg(F.sum(value).alias("total")).join(F.broadcast(top), F.lit(True)).select((F.try_divide("top", "total") * 100).alias("share_pct"))


def best_of(rows: DataFrame, group: list[str], score: str, tie: str, n: int = 2) -> DataFrame:
    """The ``n`` best rows of each group with their place and the margin to the next one."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    rows = rows.withColumns({"place": F.row_number().over(w).cast("long"), "margin": F.col(score) - F.lead(score).over(w)})
    return rows.where(F.col("place") <= n)
