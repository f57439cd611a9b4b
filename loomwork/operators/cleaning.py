"""Cleaning: outlier fences and actions, whole-series cleaning with provenance, code validation, listing cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .windows import gaps_filled

#: Divisions of the manufacturing section, and reasons for a code's rejection.
DIVISIONS = tuple(str(n) for n in range(10, 34))
MISSING, UNKNOWN, NOT_SECTION = "missing_code", "unknown_code", "not_section_c"
NOTE = "unresolved_company"


def fences(df: DataFrame, keys: list[str], value: str, method: str = "iqr", iqr_factor: float = 1.5, zscore: float = 3.0) -> DataFrame:
    """A row for each group: ``low`` and ``high`` bounds (null where nothing spreads) and the ``median``."""
    if method == "iqr":
        stats = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        spread = F.nullif(F.col("q")[2] - F.col("q")[0], F.lit(0.0))
        low, high, middle = F.col("q")[0] - spread * iqr_factor, F.col("q")[2] + spread * iqr_factor, F.col("q")[1]
    elif method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.percentile(value, 0.5).alias("q"))
        spread = F.nullif(F.col("s"), F.lit(0.0)) * zscore
        low, high, middle = F.col("m") - spread, F.col("m") + spread, F.col("q")
    else:
        raise ValueError("method is iqr or zscore")
    return stats.select(*keys, low.alias("low"), high.alias("high"), middle.alias("median"))


def with_fences(df: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """``df`` with ``low``, ``high``, ``median`` of its group and the flag ``is_outlier`` (never for null)."""
    bounds = fences(df, keys, value, **options)
    joined = df.join(bounds, keys, "left") if keys else df.join(F.broadcast(bounds), F.lit(True), "left")
    return joined.withColumn("is_outlier", F.coalesce((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")), F.lit(False)))


def acted(value: str, action: str) -> Column:
    """The value after the action on outliers: median, winsorize, null or flag (unchanged)."""
    replaced = {"median": F.col("median"), "winsorize": F.least(F.greatest(F.col(value), F.col("low")), F.col("high")), "null": F.lit(None), "flag": F.col(value)}
    if action not in replaced:
        raise ValueError(f"unknown action {action}")
    return F.when(F.col("is_outlier"), replaced[action]).otherwise(F.col(value))


def clean_series(df: DataFrame, keys: list[str], value: str = "value", max_gap: int = 2, long_gaps: bool = True, method: str = "iqr", action: str = "median", fill_trailing: bool = True, period: str = "period", **options) -> DataFrame:
    """``df`` with ``{value}_clean``, ``fill_kind`` and ``is_outlier``: gaps are filled first, then outliers acted on."""
    filled = gaps_filled(df, keys, value, max_gap, long_gaps, fill_trailing, period)
    flagged = with_fences(filled, keys, f"{value}_filled", method=method, **options)
    return flagged.withColumn(f"{value}_clean", acted(f"{value}_filled", action)).drop("low", "high", "median", f"{value}_filled")


def provenance(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for each series of what cleaning did to it."""
    kinds = {"n_observed": "observed", "n_short_filled": "short", "n_long_filled": "long", "n_missing": "missing"}
    return cleaned.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(F.count_if(F.col("fill_kind") == v).alias(k) for k, v in kinds.items()), F.count_if("is_outlier").alias("n_outliers"))


def code_reason(code: Column, known: Column) -> Column:
    """Why a classification code is rejected; null for a known code."""
    c = F.trim(code)
    in_section = c.rlike(r"^(C|1[0-9]|2[0-9]|3[0-3])")
    return F.when(c.isNull() | (c == ""), MISSING).when(known, F.lit(None)).when(in_section, UNKNOWN).otherwise(NOT_SECTION)


def validate_codes(df: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """``df`` with ``reason``; ``codes`` has one column of valid codes and is looked up by a left join."""
    known = free_name("valid", *df.columns)
    valid = codes.select(F.trim(F.col(codes.columns[0])).alias(known)).distinct()
    joined = df.join(valid, F.trim(code) == F.col(known), "left")
    return joined.withColumn("reason", code_reason(F.col(code), F.col(known).isNotNull())).drop(known)


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("checked"), F.count_if(F.col("reason").isNull()).alias("valid"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in (MISSING, UNKNOWN, NOT_SECTION)))


def clean_listings(df: DataFrame, columns: list[str], method: str = "iqr", action: str = "flag", notes: str = "notes", **options) -> DataFrame:
    """Numeric columns coerced (bad text becomes null, null stays), each with a flag ``{column}_outlier`` and acted on;
    flagged rows get a note once, however often this runs."""
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns})
    bound = {(c, x): free_name(f"{c}_{x}", *df.columns) for c in columns for x in ("low", "high", "median")}
    bounds = [fences(df, [], c, method, **options).select(*(F.col(x).alias(bound[c, x]) for x in ("low", "high", "median"))) for c in columns]
    for b in bounds:  # one row each
        df = df.join(F.broadcast(b), F.lit(True), "left")
    for c in columns:
        low, high, median = (F.col(bound[c, x]) for x in ("low", "high", "median"))
        flag = F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
        new = {"flag": F.col(c), "null": F.lit(None), "median": median, "winsorize": F.least(F.greatest(F.col(c), low), high)}[action]
        df = df.withColumn(f"{c}_outlier", flag).withColumn(c, F.when(F.col(f"{c}_outlier"), new).otherwise(F.col(c)))
        tag = F.lit(f"outlier:{c}")
        has = F.instr(F.coalesce(F.col(notes), F.lit("")), f"outlier:{c}") > 0
        df = df.withColumn(notes, F.when(~F.col(f"{c}_outlier") | has, F.col(notes)).otherwise(F.concat_ws("; ", F.nullif(F.col(notes), F.lit("")), tag)))
    return df.drop(*bound.values())
