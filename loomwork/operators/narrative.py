"""Sentences about figures by fixed templates; each names only numbers that its row has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import honest

LABELS = {"above_average": "above the average of", "below_average": "below the average of", "average": "near the average of"}


def benchmark_sentences(comparisons: DataFrame, key: str) -> DataFrame:
    """One text for each key out of the rows of a benchmark; metrics without value or peers are listed as left out."""
    said = F.col("value").isNotNull() & (F.col("peers") > 0)
    verdict = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("label"))
    number = lambda c: F.round(c, 4).cast("decimal(30,4)").cast("string")
    line = F.concat("metric", F.lit(" is "), number("value"), F.lit(", "), verdict, F.lit(" "), number("average"), F.lit(" among "), F.col("peers").cast("string"), F.lit(" peers."))
    parts = comparisons.select(key, F.when(said, F.struct("metric", line.alias("line"))).alias("s"), F.when(~said, F.col("metric")).alias("left_out"), F.array("value", "average", F.col("peers").cast("double")).alias("numbers"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_list("left_out")).alias("left_out"), F.flatten(F.collect_list("numbers")).alias("numbers"))  # one row for each metric
    rows = rows.withColumn("text", F.array_join(F.transform("s", lambda x: x.line), " "))
    allowed = F.filter("numbers", lambda v: v.isNotNull())
    return rows.select(key, "text", "left_out", honest(F.col("text"), allowed).alias("honest"))


def forecast_sentences(forecasts: DataFrame, key: str, actual: str, predicted: str) -> DataFrame:
    """The change of a forecast against the last actual value, in words; nothing is said without both."""
    pct = F.round(F.try_divide(F.col(predicted) - F.col(actual), F.abs(actual)) * 100, 2)
    way = F.when(pct > 0, "rises").when(pct < 0, "falls").otherwise("stays")
    text = F.when(pct.isNotNull(), F.concat(F.col(key).cast("string"), F.lit(" "), way, F.when(pct != 0, F.concat(F.lit(" by "), F.abs(pct).cast("string"), F.lit(" %"))).otherwise("")))
    return forecasts.select(key, pct.alias("delta_pct"), text.alias("text"))


def coverage_note(universe: DataFrame, deep: DataFrame, key: str) -> DataFrame:
    """Firms known and firms with deep figures, in one row; nothing is promoted from the one to the other."""
    return universe.agg(F.count_distinct(key).alias("n_universe")).join(F.broadcast(deep.agg(F.count_distinct(key).alias("n_deep")))).withColumn("label", F.when(F.col("n_deep") < F.col("n_universe"), "prototype_sample").otherwise("full"))


def benchmark_report(comparisons: DataFrame, key: str) -> DataFrame:
    """(key, strongest, weakest, text, citations, omitted): what a benchmark's rows (metric, value, average, peers, label, percentile) say of a firm.

    Metrics without value or peers are omitted and named so. Strongest and weakest are the metrics of the highest and the lowest
    percentile (ties: by name), null where none has one. The text names both, with the numbers it has; every number in it is cited as
    (field, value), and nothing is cited that the rows do not have. One row for each key, which has a row for each metric.
    """
    said = F.col("value").isNotNull() & (F.coalesce("peers", F.lit(0)) > 0)
    ranked = said & F.col("percentile").isNotNull()
    number = lambda c, digits: F.round(c, digits).cast(f"decimal(30,{digits})").cast("string")
    line = F.struct(F.col("metric").alias("metric"), F.col("value").alias("value"), F.col("average").alias("average"), F.col("percentile").alias("percentile"), F.col("label").alias("label"))
    rows = comparisons.groupBy(key).agg(
        F.min(F.when(ranked, F.struct((-F.col("percentile")).alias("p"), F.col("metric").alias("metric"), line.alias("line")))).alias("best"),
        F.min(F.when(ranked, F.struct(F.col("percentile").alias("p"), F.col("metric").alias("metric"), line.alias("line")))).alias("worst"),
        F.array_sort(F.collect_list(F.when(~said, F.col("metric")))).alias("omitted"),
        F.count_if(said).alias("n_said"),
    )
    verdict = lambda at: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col(f"{at}.line.label")), F.lit("against"))
    sentence = lambda at, word: F.concat(F.lit(f"{word} is "), F.col(f"{at}.metric"), F.lit(": "), number(F.col(f"{at}.line.value"), 4), F.lit(", percentile "), number(F.col(f"{at}.line.percentile"), 1), F.when(F.col(f"{at}.line.average").isNotNull(), F.concat(F.lit(", "), verdict(at), F.lit(" "), number(F.col(f"{at}.line.average"), 4))).otherwise(""), F.lit("."))
    one = F.col("best.metric") == F.col("worst.metric")
    left_out = F.when(F.size("omitted") > 0, F.concat(F.lit("No figures for "), F.array_join("omitted", ", "), F.lit(".")))
    text = F.concat_ws(" ", F.when(F.col("best").isNotNull(), sentence("best", "Strongest")), F.when(~one, sentence("worst", "Weakest")), F.when(F.col("best").isNull(), "No percentile is known."), left_out)
    cited = lambda at: F.when(F.col(at).isNotNull(), F.filter(F.array(*(F.struct(F.concat(F.col(f"{at}.metric"), F.lit(suffix)).alias("field"), F.col(f"{at}.line.{c}").cast("double").alias("value")) for c, suffix in (("value", ""), ("percentile", ".percentile"), ("average", ".average")))), lambda x: x.value.isNotNull())).otherwise(F.array().cast("array<struct<field:string,value:double>>"))
    return rows.select(key, F.col("best.metric").alias("strongest"), F.when(~one, F.col("worst.metric")).alias("weakest"), text.alias("text"), F.array_distinct(F.concat(cited("best"), F.when(~one, cited("worst")).otherwise(F.array().cast("array<struct<field:string,value:double>>")))).alias("citations"), "omitted")
