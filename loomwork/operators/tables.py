"""Keyed tables: upserts, fallback cascades, coverage, audits, job logs, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name

#: Monitored families and the jobs that belong to each; models in their canonical order; drift in MAPE points.
FAMILIES = {"gso": ("gso",), "oecd": ("oecd",), "companies": ("companies",), "marketplace": ("marketplace",), "data_cleaning": ("cleaning", "data_cleaning")}
MODELS = ("arima", "xgboost", "lightgbm", "lstm")
DRIFT_POINTS = 5.0


def last_wins(batch: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with the same keys the one that came last."""
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), sequence).alias("r")).select("r.*")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep_old_when_null: tuple[str, ...] = ()) -> DataFrame:
    """The table after the upsert, with ``_change``: inserted, updated or kept.

    Updates (unique by keys) overwrite every field, nulls included, but for ``keep_old_when_null``; one full join by keys, null ones among them.
    """
    fields = [c for c in target.columns if c not in keys]
    side = lambda df, name: df.select(*(F.col(k).alias(f"{name} key {i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"{name} field {i}") for i, c in enumerate(fields)), F.lit(True).alias(name))
    same = [F.col(f"old key {i}").eqNullSafe(F.col(f"new key {i}")) for i in range(len(keys))]
    rows = side(target, "old").join(side(updates, "new"), same, "full")
    has_new = F.col("new").isNotNull()
    key = lambda i: F.when(has_new, F.col(f"new key {i}")).otherwise(F.col(f"old key {i}"))
    kept = lambda i, c: F.coalesce(f"new field {i}", f"old field {i}") if c in keep_old_when_null else F.col(f"new field {i}")
    take = [F.when(has_new, kept(i, c)).otherwise(F.col(f"old field {i}")).alias(c) for i, c in enumerate(fields)]
    change = F.when(F.col("old").isNull(), "inserted").when(has_new, "updated").otherwise("kept")
    return rows.select(*(key(i).alias(k) for i, k in enumerate(keys)), *take, change.alias("_change"))


def write_snapshot(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table's new state to a path of its own; readers change over when it is whole."""
    table.drop("_change").write.mode(mode).parquet(path)


def cascade(candidates: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """For each group the rows of the first source in the list that has any, with ``source_tier`` and ``status``."""
    taken = [c for _, df in candidates for c in df.columns]
    tier, best, rows = free_name("tier", *taken), free_name("best_tier", *taken), None
    for i, (name, df) in enumerate(candidates):
        part = df.withColumns({tier: F.lit(i), "source_tier": F.lit(name)})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    first = rows.groupBy(*keys).agg(F.min(tier).alias(best))
    rows = (rows.join(first, keys) if keys else rows.join(F.broadcast(first), F.lit(True))).where(F.col(tier) == F.col(best))
    return rows.withColumn("status", F.when(F.col(tier) == 0, "ok").otherwise("fallback")).drop(tier, best)


def missing_codes(expected: DataFrame, present: DataFrame, code: str) -> DataFrame:
    """Expected codes without any row."""
    return expected.join(present.select(code).distinct(), code, "left_anti")


def latest_jobs(jobs: DataFrame, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """The latest job of each family; families without any job have null columns."""
    spark = jobs.sparkSession
    names = spark.createDataFrame([(f, j) for f, js in families.items() for j in js], "family string, job_name string")
    rows = jobs.join(F.broadcast(names), "job_name")
    newest = rows.groupBy("family").agg(F.max_by(F.struct("job_name", "status", "created_at", "id"), F.struct("created_at", "id")).alias("j"))
    every = spark.createDataFrame([(f,) for f in families], "family string")
    return every.join(newest, "family", "left").select("family", "j.*")


def job_state(events: DataFrame) -> DataFrame:
    """An append-only log of job events as each job's current row."""
    return events.groupBy("id").agg(F.max_by(F.struct("job_name", "status", "records_processed", "error_message", "at"), "at").alias("r"), F.min("at").alias("created_at")).select("id", "r.*", "created_at")


def job_messages(jobs: DataFrame) -> DataFrame:
    """``error`` of failed jobs and ``detail`` of others out of the one message column."""
    failed = F.col("status") == "failed"
    return jobs.withColumns({"error": F.when(failed, F.col("error_message")), "detail": F.when(~failed, F.col("error_message"))})


def is_subset(part: Column, whole: Column) -> Column:
    """Whether an array's elements are all in another; an empty one's are, a null one's are not known."""
    return F.size(F.array_except(part, whole)) == 0


def canonical_first(canonical: tuple[str, ...], found: Column) -> Column:
    """The canonical names, then those found that are none of them, in their order; each once."""
    return F.array_union(F.array(*map(F.lit, canonical)), F.coalesce(found, F.array().cast("array<string>")))


def top_drivers(gains: DataFrame, keys: list[str], gain: str = "gain", name: str = "feature", n: int = 3) -> DataFrame:
    """The ``n`` features of the largest gains above 0 of each group, ties by name, with their place."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(gain), name))
    return gains.where(F.col(gain) > 0).withColumn("place", place.cast("long")).where(F.col("place") <= n)


def source_health(rows: DataFrame, family: str, source: str, fallback: Column) -> DataFrame:
    """Rows, distinct sources, and ok, fallback or unavailable by family."""
    out = rows.groupBy(family).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(source)).alias("sources"), F.count_if(fallback).alias("n_fallback"))
    return out.withColumn("status", F.when(F.col("n_rows") == 0, "unavailable").when(F.col("n_rows") == F.col("n_fallback"), "fallback").otherwise("ok"))


def register(registry: DataFrame, model: DataFrame) -> DataFrame:
    """The registry with one more row per model; a model's newest row alone is active."""
    rows = registry.drop("is_active").unionByName(model.drop("is_active"))
    newest = F.row_number().over(Window.partitionBy("model_name").orderBy(F.desc("trained_at"), F.desc("id")))
    return rows.withColumn("is_active", newest == 1)


def drift(registry: DataFrame, baseline: DataFrame) -> DataFrame:
    """Latest MAPE of each model against its baseline: ``drift_points`` and the flag (null without either figure)."""
    newest = registry.groupBy("model_name").agg(F.max_by("mape", F.struct("is_active", "trained_at", "id")).alias("mape"))
    rows = newest.join(baseline.select("model_name", F.col("mape").alias("baseline_mape")), "model_name", "full")
    points = F.round(F.col("mape") - F.col("baseline_mape"), 4)
    return rows.withColumns({"drift_points": points, "drifted": F.abs(points) >= DRIFT_POINTS})


def preferred_model(registry: DataFrame) -> DataFrame:
    """The active model with the smallest MAPE, unknown ones last."""
    return registry.where("is_active").orderBy(F.asc_nulls_last("mape"), "id").limit(1)


def audit(flags: DataFrame, urls: DataFrame, keys: list[str]) -> DataFrame:
    """Flags (keys, flag) against URLs (keys, url): ``flag_without_url`` and ``url_without_flag`` by key."""
    rows = flags.join(urls, keys, "full")
    on = F.coalesce("flag", F.lit(False))
    has = F.col("url").isNotNull() & (F.col("url") != "")
    return rows.withColumn("mismatch", F.when(on & ~has, "flag_without_url").when(has & ~on, "url_without_flag"))


def keep_previous(now: DataFrame, before: DataFrame, keys: list[str], ok: str, fields: list[str]) -> DataFrame:
    """Fields of a failed observation are those of the last good one."""
    was = free_name("was", *now.columns)
    prior = before.select(*keys, F.struct(*fields).alias(was))
    rows = now.join(prior, keys, "left")
    return rows.withColumns({c: F.when(F.col(ok), F.col(c)).otherwise(F.col(f"{was}.{c}")) for c in fields}).drop(was)


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value that is not None; ``code__prefix`` style names compare beginnings."""
    for name, value in wanted.items():
        if value is not None:
            column, _, how = name.partition("__")
            df = df.where(F.col(column).startswith(value) if how == "prefix" else F.col(column) == value)
    return df


def numeric_metrics(metrics: Column) -> Column:
    """A map of metric names to numbers out of a map of text: lower-case names, what is no finite number becomes null."""
    number = lambda v: F.when(~F.isnan(v.try_cast("double")) & (F.abs(v.try_cast("double")) < float("inf")), v.try_cast("double"))
    return F.transform_values(F.transform_keys(metrics, lambda k, _: F.lower(F.trim(k))), lambda _, v: number(v))


def has_any(metrics: Column) -> Column:
    return F.exists(F.map_values(metrics), lambda v: v.isNotNull())
