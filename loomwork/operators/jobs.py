"""Jobs over the engine's tables: cleaning with its report, monitoring, enrichment, seeds, and what dashboards pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import write_report
from . import cleaning as C

#: How value-added levels come to be monthly, and the mark of seeded reports.
ALIGNMENT, SEED_SOURCE = "quarterly_step_hold", "seed:companies.json"


# --- cleaning ------------------------------------------------------------------------------------------------------


def clean_macro(raw: DataFrame, passed: tuple[str, ...] = (), series: str = "series", value: str = "value", period: str = "period", **options) -> DataFrame:
    """All series cleaned in one pass; those in ``passed`` go through as they are, neither filled nor held against fences.

    Gives ``{value}_clean``, ``fill_kind`` and ``is_outlier`` beside the columns.
    """
    held = F.col(series).isin(*passed) if passed else F.lit(False)
    cleaned = C.clean_series(raw.where(~held), [series], value, period=period, **options)
    if not passed:
        return cleaned
    kind = F.when(F.col(value).isNull(), "missing").otherwise("observed")
    through = raw.where(held).withColumns({"fill_kind": kind, "is_outlier": F.lit(False), f"{value}_clean": F.col(value)})
    return cleaned.unionByName(through)


def passed_metadata(raw: DataFrame, passed: tuple[str, ...], series: str = "series") -> DataFrame:
    """(series, sources, units, alignment) of the series that pass through."""
    rows = raw.where(F.col(series).isin(*passed)).groupBy(series)
    return rows.agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("unit")).alias("units")).withColumn("alignment", F.lit(ALIGNMENT))


def run_cleaning(raw: DataFrame, listings: DataFrame, validated: DataFrame, folder: str, passed: tuple[str, ...] = (), expected: tuple[str, ...] = (), columns: tuple[str, ...] = ("price", "units_sold_est", "revenue_est")) -> tuple[int, str]:
    """(records, detail): cleaned macro series and listings as Parquet below ``folder`` and a report of the counts beside them.

    ``validated`` are rows with ``reason`` from :func:`cleaning.validate_codes`; ``expected`` names series that should be there.
    """
    spark = raw.sparkSession
    macro, market = f"{folder}/cleaned_macro", f"{folder}/cleaned_marketplace"
    clean_macro(raw, passed).write.mode("overwrite").parquet(macro)
    C.clean_listings(listings, list(columns)).write.mode("overwrite").parquet(market)
    macro, market = spark.read.parquet(macro), spark.read.parquet(market)
    per_series = C.provenance(macro, ["series"])
    struct = lambda df: F.struct(*df.columns)
    counts = per_series.agg(F.array_sort(F.collect_list(struct(per_series))).alias("macro"), F.coalesce(F.sum(F.col("n_short_filled") + F.col("n_long_filled")), F.lit(0)).alias("n_filled"), F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("n_outliers"))  # a struct for each series
    flagged = market.agg(F.count("*").alias("n_listings"), *(F.count_if(f"{c}_outlier").alias(f"n_{c}_outliers") for c in columns))
    codes = C.validation_summary(validated)
    there = {r[0] for r in raw.where(F.col("series").isin(*expected)).select("series").distinct().collect()} if expected else set()
    missing = [s for s in expected if s not in there]
    report = counts.crossJoin(flagged.select(struct(flagged).alias("marketplace"))).crossJoin(codes.select(struct(codes).alias("codes")))  # one row each
    report = report.withColumn("series_missing", F.array(*map(F.lit, missing)).cast("array<string>")).withColumn("artifacts", F.array(F.lit("cleaned_macro"), F.lit("cleaned_marketplace")))
    write_report(report, f"{folder}/cleaning_report")
    r = report.first()
    records = macro.count() + r.marketplace.n_listings
    fails = r.codes.checked - r.codes.valid
    outliers = sum(r.marketplace[f"n_{c}_outliers"] for c in columns)
    # fixed value: the form of the job log's detail
    return records, f"records={records}; nan_filled={r.n_filled}; outliers={r.n_outliers}; mp_outliers_flagged={outliers}; vsic_fails={fails}; series_missing={','.join(missing) or 'none'}"


# --- monitoring and enrichment -------------------------------------------------------------------------------------


def monitor_status(jobs: DataFrame, last: int = 50) -> DataFrame:
    """(jobs_listed, jobs_failed) among the ``last`` newest jobs."""
    newest = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(last)
    return newest.agg(F.count("*").alias("jobs_listed"), F.count_if(F.col("status") == "failed").alias("jobs_failed"))


def allowlist(rows: DataFrame, code: str, position: str) -> DataFrame:
    """(code, place): distinct codes, trimmed and in capitals, in the order of their first position; empty ones are left out."""
    clean = F.upper(F.trim(F.col(code)))
    firsts = rows.where(clean != "").groupBy(clean.alias("code")).agg(F.min(position).alias("place"))
    return firsts


def fetch_status(status: Column) -> Column:
    """The state of a statement fetch in reports: live_ok, fallback, else error."""
    return F.when(status == "ok", "live_ok").when(status == "fallback", "fallback").otherwise("error")


def enrichment_counts(asked: DataFrame, fetched: DataFrame, code: str) -> DataFrame:
    """(status, n) over all codes that were asked for; those without a fetch are errors."""
    rows = asked.select(code).distinct().join(fetched.select(code, "status"), code, "left")
    return rows.groupBy(fetch_status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


# --- seeds ---------------------------------------------------------------------------------------------------------


def seed_reports(stored: DataFrame, seeds: DataFrame, key: str = "company_id") -> DataFrame:
    """``stored`` with seeded annual reports: of a seeded firm the other annual periods go, quarters stay; seeds are marked as such."""
    new = seeds.where("period IS NOT NULL").withColumns({"report_type": F.lit("annual"), "source_url": F.lit(SEED_SOURCE)})
    seeded = new.select(F.col(key).alias("seeded")).distinct()
    kept = stored.join(seeded, (F.col(key) == F.col("seeded")) & (F.col("report_type") == "annual"), "left_anti")
    return kept.unionByName(new.select(*[c for c in new.columns if c in stored.columns]), allowMissingColumns=True).select(*stored.columns)


# --- what dashboards pick ------------------------------------------------------------------------------------------


def last_points(df: DataFrame, keys: list[str], n: int = 12, period: str = "period") -> DataFrame:
    """The last ``n`` rows of each series."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(period)))
    return df.withColumn("place_from_end", rank).where(F.col("place_from_end") <= n).drop("place_from_end")


def latest_flag(points: DataFrame, keys: list[str], latest: DataFrame | None = None, period: str = "period") -> DataFrame:
    """The point at each series' latest period (of ``latest``, else its own), if it is flagged."""
    at = (points if latest is None else latest).groupBy(*keys).agg(F.max(period).alias(period))
    return points.join(at, [*keys, period]).where("is_anomaly")


def preferred_statement(reports: DataFrame, key: str, is_live: Column, period: str = "period") -> DataFrame:
    """One report of each firm: the newest live one, else the newest."""
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce(is_live, F.lit(False)).desc(), F.desc(period)))
    return reports.withColumn("place_of_report", order).where("place_of_report = 1").drop("place_of_report")


def qa_pairs(firms: DataFrame, shops: DataFrame, firm_id: str, name: str, shop: str, others: int = 2) -> DataFrame:
    """(firm_id, name, shop, label, bucket): each firm with its own shops, and with the first shop of the ``others`` firms after it by id.

    Ids follow each other in a ring of a bounded list of firms: samples are for judging matchers, not a join over all.
    """
    firsts = shops.groupBy(firm_id).agg(F.min(shop).alias(shop))
    ring = Window.orderBy(firm_id)  # the firms of a sample
    placed = firms.join(firsts, firm_id, "left").withColumns({"place": F.row_number().over(ring), "n": F.count("*").over(Window.partitionBy())})
    own = firms.join(shops.select(firm_id, shop), firm_id).select(firm_id, name, shop, F.lit(1).alias("label"), F.lit("own").alias("bucket"))
    steps = placed.select(firm_id, name, "place", "n", F.explode(F.sequence(F.lit(1), F.lit(others))).alias("step")).where("step < n")
    ahead = placed.select(F.col(shop), F.col("place").alias("at"))
    wrong = steps.join(ahead, (F.col("place") + F.col("step") - 1) % F.col("n") + 1 == F.col("at")).where(F.col(shop).isNotNull())
    return own.union(wrong.select(firm_id, name, shop, F.lit(0).alias("label"), F.lit("hard_negative").alias("bucket")))
