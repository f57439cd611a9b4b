"""Peer benchmarks: populations by metric, averages, quartiles, percentiles, labels, warnings, and consistency of extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import METRICS, benchmark_ratios, ratio, rounded
from .shared import free_name, result

#: The sizes below which a peer sample is small or gives no quartiles, and the band around the average.
SMALL_SAMPLE, QUARTILE_PEERS, BAND = 3, 4, 0.1
#: Fields of an extract and the stored fields that they are held against; deviations below 10 % are fine.
CONSISTENCY = {"operating_revenue": "revenue", "profit_before_tax": "profit_before_tax", "total_assets": "total_assets", "total_equity": "total_equity", "employees": "employees"}
TOLERANCE = 0.10


def latest_reports(reports: DataFrame, key: str = "company_id") -> DataFrame:
    """Each firm's latest report, an annual one first."""
    annual = F.lower("report_type") == "annual"
    w = Window.partitionBy(key).orderBy(F.desc(F.coalesce(annual, F.lit(False))), F.desc("period"))
    place = free_name("place", *reports.columns)
    return reports.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def long_ratios(reports: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(keys, metric, value) of the benchmark ratios, nulls dropped."""
    return benchmark_ratios(reports).unpivot(keys, list(metrics), "metric", "value").where("value IS NOT NULL")


def placed_values(rows: DataFrame, keys: list[str], value: str = "value", weight: Column | None = None, ranges: int = 64) -> DataFrame:
    """(keys, value, n, le, total): each distinct value with its rows, the rows at or below it, and all rows of its group.

    ``weight`` is what a row counts (1). Values are counted before they are ordered, and ordered in ``ranges`` of a group's
    values by approximate quantiles, with sums before each range: no group is sorted in one task, and the places are exact.
    Values are stored with their ranges, as approximate quantiles that are computed twice need not be the same.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts"))
    ranged = result(counts.join(cuts, keys).select(*keys, value, "n", F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("value_range")), "ranges")
    group = Window.partitionBy(*keys)  # a row for each range
    before = group.orderBy("value_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy(*keys, "value_range").agg(F.sum("n").alias("in_range")).select(*keys, "value_range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("ahead"), F.sum("in_range").over(group).alias("total"))
    inside = Window.partitionBy(*keys, "value_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("inside", F.sum("n").over(inside)).join(ahead, [*keys, "value_range"]).select(*keys, value, "n", (F.col("ahead") + F.col("inside")).alias("le"), "total")


def quantile(share: float) -> Column:
    """The linearly interpolated quantile of a group of :func:`placed_values`, as an aggregate."""
    at = (F.col("total") - 1) * F.lit(share)
    value_at = lambda place: F.max(F.when((F.col("le") - F.col("n") <= place) & (place < F.col("le")), F.col("value")))
    low, high = value_at(F.floor(at)), value_at(F.ceil(at))
    return low + (high - low) * F.max(at - F.floor(at))


def statistics(population: DataFrame, keys: list[str]) -> DataFrame:
    """Peers, average and quartiles (none for fewer than four peers) of ``value`` by group."""
    rows = population.groupBy(*keys).agg(F.count("value").alias("peers"), rounded(F.avg("value"), 4).alias("average"))
    quartiles = placed_values(population, keys).groupBy(*keys).agg(*(quantile(q).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)))
    band = lambda p: F.when(F.col("peers") >= QUARTILE_PEERS, rounded(F.col(p), 6)).alias(p)
    return rows.join(quartiles, keys, "left").select(*keys, "peers", "average", band("p25"), band("p50"), band("p75"))


def percentiles(population: DataFrame, keys: list[str], name: str = "percentile") -> DataFrame:
    """Share of peers whose value is no larger, in percent."""
    placed = placed_values(population, keys).select(*keys, "value", rounded(F.col("le") / F.col("total") * 100, 1).alias(name))
    return population.join(placed, [*keys, "value"], "left")


def label(value: Column, average: Column, peers: Column) -> Column:
    """Against the rounded average, with a band of a tenth of it."""
    return F.when(F.coalesce(peers, F.lit(0)) == 0, "insufficient_peers").when(value > average * (1 + BAND), "above_average").when(value < average * (1 - BAND), "below_average").otherwise("average")


def warnings(peers: Column) -> Column:
    return F.array_compact(F.array(F.when(peers == 0, "insufficient_peers"), F.when(peers > 0, "prototype_listed_sample"), F.when(peers < SMALL_SAMPLE, "small_peer_sample")))


def compare(targets: DataFrame, peers: DataFrame, group: str, key: str = "company_id", metrics: tuple[str, ...] = METRICS, exclude_self: bool = False) -> DataFrame:
    """For each target and metric: its value, the peers' statistics, its percentile and label.

    Peers of a target share its ``group``. Statistics are computed once a group; with ``exclude_self`` each target's own
    value is taken out of count, average and percentile (quartiles are left out then).
    """
    population = long_ratios(peers, [key, group], metrics)
    own = benchmark_ratios(targets).unpivot([key, group], list(metrics), "metric", "value")
    if exclude_self:
        sums = population.groupBy(group, "metric").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
        places = placed_values(population, [group, "metric"]).select(group, "metric", "value", "le")
        mine = population.join(places, [group, "metric", "value"]).select(key, group, "metric", "le", F.col("value").alias("own"))
        rows = own.join(sums, [group, "metric"], "left").join(mine, [key, group, "metric"], "left")
        n = F.coalesce("n", F.lit(0)) - F.col("own").isNotNull().cast("int")
        average = rounded(ratio(F.col("s") - F.coalesce("own", F.lit(0.0)), n), 4)
        return rows.select(key, group, "metric", "value", n.alias("peers"), average.alias("average"), rounded(ratio(F.col("le") - 1, n) * 100, 1).alias("percentile")).withColumn("label", label(F.col("value"), F.col("average"), F.col("peers")))
    stats = statistics(population, [group, "metric"])
    # targets' values take places among the peers' without counting themselves
    both = population.select(group, "metric", "value", F.lit(1).alias("counts")).unionByName(own.where("value IS NOT NULL").select(group, "metric", "value", F.lit(0).alias("counts")))
    places = placed_values(both, [group, "metric"], weight=F.col("counts")).select(group, "metric", "value", "le")
    placed = own.join(places, [group, "metric", "value"]).select(key, group, "metric", "le")
    rows = own.join(stats, [group, "metric"], "left").join(placed, [key, group, "metric"], "left")
    rows = rows.withColumns({"peers": F.coalesce("peers", F.lit(0)), "percentile": rounded(ratio("le", "peers") * 100, 1)}).drop("le")
    return rows.withColumn("label", F.when(F.col("value").isNotNull(), label(F.col("value"), F.col("average"), F.col("peers")))).withColumn("warnings", warnings(F.col("peers")))


def consistency(extracts: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, field, extracted, stored, deviation, severity, note) of the five fields both sides may have."""
    left = extracts.select(key, *(F.col(f).cast("double") for f in CONSISTENCY)).unpivot([key], list(CONSISTENCY), "field", "extracted")
    right = stored.select(key, *(F.col(s).cast("double").alias(f) for f, s in CONSISTENCY.items())).unpivot([key], list(CONSISTENCY), "field", "stored")
    rows = left.join(right, [key, "field"], "left").withColumn("deviation", ratio(F.abs(F.col("extracted") - F.col("stored")), F.abs("stored")))
    missing = F.col("extracted").isNull() | F.col("stored").isNull()
    zero = F.col("stored") == 0
    same_zero = zero & (F.col("extracted") == 0)
    severity = F.when(missing, "warn").when(same_zero, "ok").when(zero, "mismatch").when(F.col("deviation") < TOLERANCE, "ok").otherwise("mismatch")
    return rows.withColumns({"severity": severity, "note": F.when(missing, "missing").when(zero & ~same_zero, "zero_db")})
