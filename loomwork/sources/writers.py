"""Sinks: reports as JSON, CSV and Markdown, append-only logs that refuse secrets, metric baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that feedback may name, and marks of secrets or binary data.
FEEDBACK_FIELDS = ("stock_code", "vsic_code", "operating_revenue", "profit_before_tax", "total_assets", "total_equity", "current_assets", "current_liabilities", "employees", "operating_expenses", "cost_of_goods", "rental_cost", "remuneration")
SECRET = r"(?i)api[_-]?key|authorization|password|secret|bearer\s|raw_pdf|file_bytes|base64,|[A-Za-z0-9+/]{200,}"


def is_safe(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & ~F.coalesce(c.rlike(SECRET), F.lit(False))
    return out


def sanitized(edits: DataFrame) -> DataFrame:
    """Edits (field, before, after) of allowed fields without secrets or binary data."""
    return edits.where(F.col("field").isin(*FEEDBACK_FIELDS) & is_safe(F.col("before"), F.col("after")))


def append_log(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines at the end of a log folder; unsafe rows are an error before anything is written."""
    text = F.to_json(F.struct("*"))
    if not rows.where(~is_safe(text)).limit(1).isEmpty():
        raise ValueError("a record holds a secret or binary data")
    rows.write.mode("append").json(path)


def write_report(counts: DataFrame, path: str) -> None:
    """A one-row report of nested counts as JSON."""
    counts.coalesce(1).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, most_rows: int = 500) -> str:
    """A table of up to ``most_rows`` rows as Markdown, for reports that people read."""
    head = rows.limit(most_rows).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(rows.columns), line("-" * len(rows.columns)), *map(line, head)]) + "\n"


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_baseline(registry: DataFrame, path: str, threshold: float = 5.0) -> int:
    """The latest MAPE of each model as a baseline table; an empty one is refused."""
    rows = registry.where("mape IS NOT NULL").groupBy("model_name").agg(F.max_by("mape", F.struct("trained_at", "id")).alias("mape"), F.max("trained_at").alias("trained_at"))
    n = rows.count()
    if not n:
        raise ValueError("no model has a MAPE: the baseline is left as it is")
    rows.withColumn("threshold", F.lit(threshold)).write.mode("overwrite").parquet(path)
    return n
