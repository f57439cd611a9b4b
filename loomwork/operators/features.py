"""The monthly feature frame: value features, digital and financial context by month, warm-up, checks and manifest."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cleaning as C
from . import windows as W
from .metrics import feature_ratios
from .shared import free_name

#: Groups of context columns.
DIGITAL = ("digital_adoption_score", "channel_diversity", "online_revenue_ratio")
FINANCIAL = ("roa", "roe", "current_ratio")
FORBIDDEN = ("mei_bci",)


def usable_artifact(spark: SparkSession, path: str, target: str = "iip") -> DataFrame | None:
    """A cleaned macro frame that is there, can be read, has rows and the target's column; else None."""
    try:
        df = spark.read.parquet(path)
        return None if target not in df.columns or df.isEmpty() else df
    except (PySparkException, Py4JJavaError):
        return None  # not there, or what a failed job has left


def load_macro(spark: SparkSession, artifact: str, rows: DataFrame, series: dict[str, Column], target: str = "iip") -> DataFrame:
    """One row a month: the cleaned artifact where it is usable, else the table's series side by side with only the target cleaned.

    ``rows`` is (period, value and what ``series`` asks for); ``series`` gives each column's condition on them. Periods become the first
    of their month; of several values of a month the last one counts. ``source`` says which way it went. Forbidden columns never come along.
    """
    month = F.trunc("period", "MM").alias("period")
    cleaned = usable_artifact(spark, artifact, target)
    if cleaned is not None:
        return cleaned.select(month, *(c for c in cleaned.columns if c != "period" and c not in FORBIDDEN)).withColumn("source", F.lit("artifact"))
    wanted = {c: on for c, on in series.items() if c not in FORBIDDEN}
    asked = F.coalesce(F.greatest(F.lit(False), *wanted.values()), F.lit(False))  # a month with a null value alone is a month
    wide = rows.where(asked).select(month, *(F.when(on, F.struct(F.col("period").alias("at"), "value")).alias(c) for c, on in wanted.items())).groupBy("period").agg(*(F.max(c).alias(c) for c in wanted))
    wide = wide.select("period", *(F.col(f"{c}.value").alias(c) for c in wanted))
    one = wide.withColumn("whole", F.lit(0)).withColumnRenamed(target, "value")
    clean = C.clean_series(one, ["whole"], "value")
    return clean.select("period", *(F.col("value_clean").alias(c) if c == target else F.col(c) for c in wanted)).withColumn("source", F.lit("table"))


def digital_by_month(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean digital metrics of the last snapshot up to each month; a single snapshot holds for every month."""
    means = snapshots.groupBy(F.trunc("period", "MM").alias("period")).agg(*(F.avg(c).alias(c) for c in DIGITAL))
    one = means.agg(F.count("*").alias("snapshots"), *(F.first(c).alias(f"only_{c}") for c in DIGITAL))  # one row
    key = free_name("whole", "period", *DIGITAL)
    held = W.asof_backward(calendar.select("period", F.lit(0).alias(key)), means.withColumn(key, F.lit(0)), [key], list(DIGITAL)).drop(key).join(F.broadcast(one), F.lit(True))
    single = F.col("snapshots") == 1
    return held.select("period", *(F.when(single, F.col(f"only_{c}")).otherwise(F.col(c)).alias(c) for c in DIGITAL), F.when(single, "broadcast_latest").otherwise("period_aggregate").alias("digital_alignment"))


def financial_by_month(reports: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean ratios of each report period over its months: a quarter's, or a year's where all reports are annual; a single one holds for every month."""
    annual = F.lower(F.trim(F.coalesce("report_type", F.lit("")))) == "annual"
    by = feature_ratios(reports).groupBy("period").agg(*(F.avg(c).alias(c) for c in FINANCIAL), F.bool_and(annual).alias("annual"))
    one = by.agg(F.count("*").alias("reports"), *(F.first(c).alias(f"only_{c}") for c in FINANCIAL))  # one row
    start = F.when(F.col("annual"), F.trunc("period", "YEAR")).otherwise(F.trunc("period", "QUARTER"))
    held = W.step_held(by.withColumn("period", start), F.when(F.col("annual"), 12).otherwise(3))
    # where a year and a quarter cover the same month, the quarter counts: one row for each month
    each = held.groupBy("period").agg(F.max_by(F.struct(*FINANCIAL, "annual"), ~F.col("annual")).alias("r")).select("period", "r.*")
    tag = F.when(F.col("annual"), "step_hold_annual").when(~F.col("annual"), "step_hold_quarter")
    single = F.col("reports") == 1
    rows = calendar.join(each, "period", "left").join(F.broadcast(one), F.lit(True))
    return rows.select("period", *(F.when(single, F.col(f"only_{c}")).otherwise(F.col(c)).alias(c) for c in FINANCIAL), F.when(single, "broadcast_latest").otherwise(tag).alias("financial_alignment"))


def build(macro: DataFrame, snapshots: DataFrame, reports: DataFrame, target: str = "iip", peer: str = "indigo", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a month (of each series, by ``keys``): lags, trailing means and growth of target and peer, context, and their product; warm-up rows dropped."""
    one = free_name("whole", *macro.columns)
    rows = macro.drop(*FORBIDDEN) if keys else macro.drop(*FORBIDDEN).withColumn(one, F.lit(0))
    key = list(keys) or [one]
    rows = W.growth(W.rolling_means(W.lags(rows, key, target), key, target), key, target, f"{target}_growth")
    if peer in macro.columns:
        rows = W.lags(rows, key, peer, (1,))
    calendar = macro.select(F.trunc("period", "MM").alias("period")).where("period IS NOT NULL").distinct()
    rows = rows.drop(one).join(digital_by_month(snapshots, calendar), "period", "left").join(financial_by_month(reports, calendar), "period", "left")
    rows = rows.withColumn("digital_x_growth", F.col("digital_adoption_score") * F.col(f"{target}_growth"))
    return rows.dropna(subset=[target, *(f"{target}_lag{k}" for k in (1, 2, 3))])


def validate(frame: DataFrame, target: str = "iip") -> list[str]:
    """What is wrong with a feature frame, by one pass over it."""
    wanted = [target, *(f"{target}_lag{k}" for k in (1, 2, 3)), *DIGITAL, *FINANCIAL]
    bad = [f"missing column {c}" for c in wanted if c not in frame.columns] + [f"forbidden column {c}" for c in FORBIDDEN if c in frame.columns]
    if bad:
        return bad
    n = frame.agg(F.count("*").alias("rows"), F.count_distinct("period").alias("periods"), *(F.count_if(F.col(c).isNull()).alias(c) for c in wanted[:4])).first()
    bad += [] if n["rows"] == n["periods"] else ["more than one row for a month"]
    return bad + [f"null {c}" for c in wanted[:4] if n[c]]


def manifest(frame: DataFrame) -> DataFrame:
    """A one-row description: rows, span, columns and alignment tags."""
    tags = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in ("digital_alignment", "financial_alignment")]
    return frame.agg(F.count("*").alias("n_rows"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.lit(len(frame.columns)).cast("long").alias("n_columns"), *tags)
