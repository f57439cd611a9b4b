"""Ordered-frame operators over long series frames (series keys, period, value): lags, means, gaps, as-of joins, step-hold.

Every window is partitioned by the series keys, so a frame of many series is one shuffle, and orders explicitly by period.
Missing is null, never NaN; zero denominators give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .shared import free_name

Keys = list[str]


def ordered(keys: Keys, period: str = "period") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(period)


def lags(df: DataFrame, keys: Keys, value: str, by: tuple[int, ...] = (1, 2, 3), period: str = "period") -> DataFrame:
    """Columns ``{value}_lag{k}``."""
    w = ordered(keys, period)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in by})


def rolling_means(df: DataFrame, keys: Keys, value: str, rows: tuple[int, ...] = (3, 6), period: str = "period") -> DataFrame:
    """Columns ``{value}_roll{n}m``: the mean of the last n rows' values that are there."""
    w = ordered(keys, period)
    return df.withColumns({f"{value}_roll{n}m": F.avg(value).over(w.rowsBetween(1 - n, 0)) for n in rows})


def growth(df: DataFrame, keys: Keys, value: str, name: str, period: str = "period") -> DataFrame:
    """Change against the row before, both taken from the series with its gaps held at the last value."""
    w = ordered(keys, period)
    held = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    now, before = free_name("held_now", *df.columns), free_name("held_before", *df.columns)
    df = df.withColumn(now, held).withColumn(before, F.lag(now).over(w))
    return df.withColumn(name, F.try_divide(now, F.col(before)) - 1).drop(now, before)


def gap_lengths(df: DataFrame, keys: Keys, value: str, name: str = "gap_rows", period: str = "period") -> DataFrame:
    """Rows of the contiguous run of nulls that a row stands in; 0 where the value is there."""
    w = ordered(keys, period)
    run = free_name("run", *df.columns)
    df = df.withColumn(run, F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))  # grows at each value, stands still inside a gap
    n = F.count_if(F.col(value).isNull()).over(Window.partitionBy(*keys, run))
    return df.withColumn(name, F.when(F.col(value).isNull(), n).otherwise(F.lit(0)).cast("long")).drop(run)


def interpolated(df: DataFrame, keys: Keys, value: str, name: str, fill_trailing: bool = True, period: str = "period") -> DataFrame:
    """Linear interpolation by row position. Leading nulls stay; trailing ones take the last value if ``fill_trailing``."""
    w = ordered(keys, period)
    row, before, after = (free_name(c, *df.columns) for c in ("row_at", "value_before", "value_after"))
    df = df.withColumn(row, F.row_number().over(w))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(row).alias("row"), F.col(value).alias("v")))
    df = df.withColumn(before, F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the next value is the last one from the end: a frame that shrinks row by row would cost the square of the rows
    df = df.withColumn(after, F.last(here, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(row)).rowsBetween(Window.unboundedPreceding, 0)))
    p, n = F.col(before), F.col(after)
    line = p.v + (n.v - p.v) * (F.col(row) - p["row"]) / F.nullif(n["row"] - p["row"], F.lit(0))
    filled = F.coalesce(F.col(value), line, p.v if fill_trailing else F.lit(None))
    return df.withColumn(name, filled).drop(row, before, after)


def gaps_filled(df: DataFrame, keys: Keys, value: str, max_gap: int = 2, long_gaps: bool = True, fill_trailing: bool = True, period: str = "period") -> DataFrame:
    """``{value}_filled`` and ``fill_kind`` (observed, short, long, missing): short gaps are runs of at most ``max_gap`` nulls."""
    gap, line = free_name("gap", *df.columns), free_name("line", *df.columns)
    df = interpolated(gap_lengths(df, keys, value, gap, period), keys, value, line, fill_trailing, period)
    short = (F.col(gap) > 0) & (F.col(gap) <= max_gap)
    filled = F.when(F.col(gap) == 0, F.col(value)).when(short | F.lit(long_gaps), F.col(line))
    kind = F.when(F.col(gap) == 0, "observed").when(F.col(f"{value}_filled").isNull(), "missing").when(short, "short").otherwise("long")
    return df.withColumn(f"{value}_filled", filled).withColumn("fill_kind", kind).drop(gap, line)


def latest(df: DataFrame, keys: Keys, *order: Column) -> DataFrame:
    """The first row of each group in the given order (descending columns first)."""
    place = free_name("place", *df.columns)
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def asof_backward(left: DataFrame, right: DataFrame, keys: Keys, columns: Keys, period: str = "period") -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its period, by a union and one window."""
    side, found = free_name("side", *left.columns), free_name("found", *left.columns)
    marked = right.select(*keys, period, F.lit(0).alias(side), F.struct(*columns).alias(found))
    rows = left.withColumn(side, F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(period, side).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(found, F.last(found, ignorenulls=True).over(w)).where(F.col(side) == 1)
    return rows.select(*(c for c in left.columns if c not in columns), *(F.col(f"{found}.{c}").alias(c) for c in columns))


def broadcast_latest(calendar: DataFrame, one: DataFrame, columns: Keys) -> DataFrame:
    """A snapshot of one row on every row of ``calendar``."""
    return calendar.join(F.broadcast(one.select(*columns).limit(1)), F.lit(True), "left")


def months_of(start: Column, n: int | Column) -> Column:
    """The first days of ``n`` months from ``start``."""
    first = F.trunc(start, "MM")
    return F.sequence(first, F.add_months(first, (F.lit(n) if isinstance(n, int) else n) - 1), F.expr("interval 1 month"))


def step_held(df: DataFrame, months: Column | int, period: str = "period") -> DataFrame:
    """Each row once for each of the months from its period on, all with its values."""
    month = free_name("month", *df.columns)
    return df.withColumn(month, F.explode(months_of(F.col(period), months))).drop(period).withColumnRenamed(month, period).select(*df.columns)


def quarters_to_months(df: DataFrame, keys: Keys, value: str = "value", period: str = "period") -> DataFrame:
    """Quarterly values on a line to the next quarter, month by month; the last quarter is held flat for its three months."""
    w = ordered(keys, period)
    start, nxt = F.trunc(period, "MM"), F.lead(period).over(w)
    rows = df.select(*keys, F.col(period).alias("__p"), F.col(value).alias("__v"), F.trunc(nxt, "MM").alias("__np"), F.lead(value).over(w).alias("__nv"))
    start = F.trunc("__p", "MM")
    span = F.coalesce(F.months_between("__np", start).cast("int"), F.lit(3))
    rows = rows.withColumn("__span", span).select("*", F.posexplode(months_of(F.col("__p"), F.col("__span"))).alias("__i", period))
    line = F.col("__v") + (F.coalesce("__nv", "__v") - F.col("__v")) * F.col("__i") / F.col("__span")
    return rows.select(*keys, period, line.alias(value))


def harmonised(df: DataFrame, keys: Keys, value: str = "value", period: str = "period", frequency: str = "freq") -> DataFrame:
    """Monthly rows of series that come by month, quarter or year: quarters where a group has any, on a line to the next; years held."""
    one = preferred_frequency(df, keys, frequency)
    pick = lambda f: one.where(F.col(frequency) == f).select(*keys, period, value)
    return pick("M").unionByName(quarters_to_months(pick("Q"), keys, value, period)).unionByName(step_held(pick("A").withColumn(period, F.trunc(period, "YEAR")), 12, period))


def preferred_frequency(df: DataFrame, keys: Keys, frequency: str = "freq", preferred: str = "Q") -> DataFrame:
    """Rows of the preferred frequency where a group has any, else all of the group's."""
    has = free_name("has", *df.columns)
    df = df.withColumn(has, F.max(F.col(frequency) == preferred).over(Window.partitionBy(*keys)))
    return df.where(~F.col(has) | (F.col(frequency) == preferred)).drop(has)


def month_on_month(df: DataFrame, keys: Keys, value: str, period: str = "period") -> DataFrame:
    """``mom_pct`` against the row before and ``yoy_pct`` against the same day of the year before, both null without it."""
    w = ordered(keys, period)
    before = F.lag(value).over(w)
    last, last_year = free_name("last", *df.columns), free_name("last_year", *df.columns)
    year = df.select(*keys, F.add_months(period, 12).alias(period), F.col(value).alias(last_year))
    df = df.withColumn(last, before).join(year, [*keys, period], "left")
    pct = lambda base: F.try_divide(F.col(value) - F.col(base), F.col(base)) * 100
    return df.withColumns({"mom_pct": pct(last), "yoy_pct": pct(last_year)}).drop(last, last_year)


def is_monthly(df: DataFrame, keys: Keys, period: str = "period") -> DataFrame:
    """For each group whether its periods are more than one and consecutive months."""
    month = F.year(period) * 12 + F.month(period)
    rows = df.select(*keys, month.alias("m")).distinct()
    return rows.groupBy(*keys).agg(((F.count("*") > 1) & (F.max("m") - F.min("m") + 1 == F.count("*"))).alias("is_monthly"))


def sequences(df: DataFrame, keys: Keys, value: str, length: int = 12, horizon: int = 6, period: str = "period") -> DataFrame:
    """Supervised windows: ``x`` of ``length`` values up to a row and ``y`` of ``horizon`` values after it; whole windows only."""
    w = ordered(keys, period)
    rows = df.select(*keys, period, F.collect_list(value).over(w.rowsBetween(1 - length, 0)).alias("x"), F.collect_list(value).over(w.rowsBetween(1, horizon)).alias("y"))
    return rows.where((F.size("x") == length) & (F.size("y") == horizon))


def lag_violations(df: DataFrame, keys: Keys, value: str, lag_column: str, by: int, period: str = "period", rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Rows where ``lag_column`` is not ``value`` shifted by ``by`` rows."""
    want = F.lag(value, by).over(ordered(keys, period))
    wanted = free_name("wanted", *df.columns)
    close = F.abs(F.col(lag_column) - F.col(wanted)) <= F.lit(atol) + F.lit(rtol) * F.abs(wanted)
    same = F.coalesce(close, F.col(lag_column).isNull() & F.col(wanted).isNull())
    return df.withColumn(wanted, want).where(~same).drop(wanted)


def walk_forward(df: DataFrame, keys: Keys, min_train: int = 24, test_size: int = 6, step: int = 1, mode: str = "expanding", train_rows: int | None = None, period: str = "period") -> DataFrame:
    """(keys, period, fold, role): chronological folds whose train rows all precede their test rows.

    Fold i tests ``test_size`` rows from row ``min_train + i * step`` on; ``rolling`` folds train on the last ``train_rows``
    (``min_train`` by default) rows before them, ``expanding`` ones on all.
    """
    if mode not in ("expanding", "rolling"):
        raise ValueError("mode is expanding or rolling")
    at, n, fold, role = (free_name(c, *df.columns) for c in ("row_at", "rows_in_all", "fold", "role"))
    rows = df.withColumns({at: F.row_number().over(ordered(keys, period)) - 1, n: F.count("*").over(Window.partitionBy(*keys))}).where(F.col(n) >= min_train + test_size)
    train = train_rows or min_train
    # fold i tests [min_train + i * step, + test_size) and trains on what is before, so a row's folds follow from its place
    first = F.ceil((F.col(at) - min_train - test_size + 1) / step)
    last = F.floor((F.col(n) - min_train - test_size) / step)
    if mode == "rolling":
        last = F.least(last, F.floor((F.col(at) - min_train + train) / step))
    first, last = F.greatest(first, F.lit(0)).cast("int"), last.cast("int")
    rows = rows.where(first <= last).withColumn(fold, F.explode(F.sequence(first, last)))
    origin = F.lit(min_train) + F.col(fold) * step
    rows = rows.withColumn(role, F.when(F.col(at) >= origin, "test").when(F.lit(mode == "expanding") | (F.col(at) >= origin - train), "train"))
    rows = rows.where(F.col(role).isNotNull())
    return rows.select(*(c for c in df.columns if c.lower() not in ("fold", "role")), F.col(fold).cast("long").alias("fold"), F.col(role).alias("role"))


def fixed_split(df: DataFrame, train_end: str, test_start: str, period: str = "period") -> DataFrame:
    """Rows up to the end of month ``train_end`` as train and from month ``test_start`` on as test; those between are dropped."""
    month = F.date_format(period, "yyyy-MM")
    role = F.when(month <= train_end, "train").when(month >= test_start, "test")
    if test_start <= train_end:
        raise ValueError("the test months must come after the train months")
    return df.withColumn("role", role).where("role IS NOT NULL")
