"""Lags, means, growth, gaps and as-of joins of series that are too long for one task.

Rows are dealt to ranges of (series, period), each of which is a segment of bounded size and a task's work; a series may lie in many
segments, and only series that do need anything from outside. Such a segment gets the few rows before it that its lags and means
look back to (its halo), and what the segments before and after it come down to: their numbers of rows, and the last and the first value in
them. These summaries are a row for each segment of a divided series, so their number grows with the segments and not with the rows.

Results are those of :mod:`windows` on the same rows. Rows of one series and period stay together; their order is open, as there. Null
keys are a series of their own. Added columns with the name of one there replace it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .shared import free_name, new_folder, small, stored

#: Rows of a segment.
ROWS = 1_000_000


class Segmented:
    """A frame in segments; each method gives a frame with more columns, and :attr:`df` is the rows as they are now."""

    def __init__(self, df: DataFrame, keys: list[str], period: str = "period", rows: int = ROWS):
        self.keys, self.period = list(keys), period
        self.columns = list(df.columns)
        self.segment = free_name("segment", *df.columns)
        n = max(1, -(-df.count() // rows))
        dealt = df.repartitionByRange(n, *(F.col(c) for c in (*keys, period))).withColumn(self.segment, F.spark_partition_id())
        # stored, so that a row's segment is the same wherever it is asked for
        self.rows = self.base = stored(dealt, new_folder(df.sparkSession, "segments"))

    @property
    def df(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def _added(self, rows: DataFrame, *names: str) -> Segmented:
        _ = self.divided  # found once for all that follows
        out = object.__new__(Segmented)
        out.__dict__.update(self.__dict__)
        out.columns = [*(c for c in self.columns if c not in names), *names]
        out.rows = rows.select(*out.columns, self.segment)
        return out

    @property
    def _place(self) -> list[str]:
        return [*self.keys, self.segment]

    def _same(self, other: DataFrame, left: DataFrame) -> Column:
        on = left[self.segment] == other["at_segment"]
        for i, k in enumerate(self.keys):
            on = on & left[k].eqNullSafe(other[f"key{i}"])
        return on

    @cached_property
    def divided(self) -> DataFrame:
        """(key0.., at_segment, n, before, total): rows of each segment of the series that lie in more than one, before it, and of the series."""
        counts = self.base.groupBy(*(F.col(k).alias(f"key{i}") for i, k in enumerate(self.keys)), F.col(self.segment).alias("at_segment")).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*(f"key{i}" for i in range(len(self.keys))))
        place = w.orderBy("at_segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = counts.withColumns({"segments": F.count("*").over(w), "before": F.sum("n").over(place) - F.col("n"), "total": F.sum("n").over(w)}).where("segments > 1").drop("segments")
        return stored(rows, new_folder(self.rows.sparkSession, "divided"))

    def _of_divided(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with the segment) of divided series alone, keys as key0.., the segment as at_segment."""
        about = small(self.divided.select("at_segment", *(f"key{i}" for i in range(len(self.keys)))), 1_000_000)
        kept = rows.join(about, self._same(about, rows))
        return kept.drop(*self._place)

    def _stored(self, value: str) -> DataFrame:
        """Rows that have a column and are stored; only columns of the frame itself can be looked back to."""
        if value not in self.base.columns:
            raise ValueError(f"{value} is no column of the frame that was dealt to segments")
        return self.base

    # --- looking back a few rows ---

    def _with_halo(self, value: str, k: int) -> tuple[DataFrame, str]:
        """The rows and, marked by a column, the last ``k`` rows of the series before each segment."""
        mark, key = free_name("halo", *self.rows.columns), [f"key{i}" for i in range(len(self.keys))]
        last = self._stored(value).select(*self._place, self.period, value).withColumn("back", F.row_number().over(Window.partitionBy(*self._place).orderBy(F.desc(self.period)))).where(F.col("back") <= k)
        tails = self._of_divided(last).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at_segment", (-F.col("back")).alias("back"), F.col(self.period).alias("p"), F.col(value).alias("v")))).alias("tails"))  # k rows a segment
        each = self.divided.alias("d").join(tails.alias("t"), [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key] or F.lit(True)).select(*(F.col(f"d.{c}") for c in key), "d.at_segment", "t.tails")
        earlier = F.filter("tails", lambda t: t.at_segment < F.col("at_segment"))
        near = each.select(*key, "at_segment", F.explode(F.slice(earlier, F.greatest(F.size(earlier) - k + 1, F.lit(1)), F.lit(k))).alias("t"))
        halo = near.select(*(F.col(f"key{i}").alias(c) for i, c in enumerate(self.keys)), F.col("at_segment").alias(self.segment), F.col("t.p").alias(self.period), F.col("t.v").alias(value), F.lit(True).alias(mark))
        return self.rows.withColumn(mark, F.lit(False)).unionByName(halo, allowMissingColumns=True), mark

    def lags(self, value: str, by: tuple[int, ...] = (1, 2, 3)) -> Segmented:
        """Columns ``{value}_lag{k}``."""
        rows, mark = self._with_halo(value, max(by))
        return self._added(W.lags(rows, self._place, value, by, self.period).where(~F.col(mark)), *(f"{value}_lag{k}" for k in by))

    def rolling_means(self, value: str, rows: tuple[int, ...] = (3, 6)) -> Segmented:
        """Columns ``{value}_roll{n}m``: the mean of the last n rows' values that are there."""
        frame, mark = self._with_halo(value, max(rows) - 1)
        return self._added(W.rolling_means(frame, self._place, value, rows, self.period).where(~F.col(mark)), *(f"{value}_roll{n}m" for n in rows))

    # --- values carried over any number of rows ---

    def _neighbours(self, value: str) -> DataFrame:
        """The rows with their place and the total of the series, and as (row, v) the nearest value before each, at or before, and at or after it."""
        w = Window.partitionBy(*self._place).orderBy(self.period)
        at = lambda rows: rows.withColumn("row", F.row_number().over(w)).withColumn("here", F.when(F.col(value).isNotNull(), F.struct(F.col("row").cast("long").alias("row"), F.col(value).alias("v"))))
        rows = at(self.rows)
        upto = lambda last: F.last("here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, last))
        rows = rows.withColumns({"p": upto(0), "q": upto(-1), "f": F.last("here", ignorenulls=True).over(Window.partitionBy(*self._place).orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)), "in_segment": F.count("*").over(Window.partitionBy(*self._place))})
        ends = self._of_divided(at(self._stored(value)).groupBy(*self._place).agg(F.min("here").alias("first"), F.max("here").alias("last")))  # a row for each segment
        key = [f"key{i}" for i in range(len(self.keys))]
        about = self.divided.alias("d").join(ends.alias("e"), [F.col("d.at_segment") == F.col("e.at_segment"), *(F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in key)], "left").select("d.*", "e.first", "e.last")
        moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.row") + F.col("before")).alias("row"), F.col(f"{c}.v").alias("v")))
        order = Window.partitionBy(*key).orderBy("at_segment")
        about = about.withColumns({"first": moved("first"), "last": moved("last")})
        about = about.select(*key, "at_segment", "before", "total", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.last("first", ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("at_segment")).rowsBetween(Window.unboundedPreceding, -1)).alias("coming"))
        about = small(stored(about, new_folder(self.rows.sparkSession, "carried")), 1_000_000)
        joined = rows.join(about, self._same(about, rows), "left")
        up = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.row") + F.coalesce("before", F.lit(0))).alias("row"), F.col(f"{c}.v").alias("v")))
        place = F.col("row") + F.coalesce("before", F.lit(0))
        return joined.select(*(rows[c] for c in (*self.columns, self.segment)), place.alias("row"), F.coalesce("total", "in_segment").alias("total"), F.coalesce(up("q"), "carried").alias("earlier"), F.coalesce(up("p"), "carried").alias("before"), F.coalesce(up("f"), "coming").alias("after"))

    def _checked(self) -> None:
        own = {"row", "here", "p", "q", "f", "in_segment", "total", "earlier", "before", "after", "carried", "coming", "n", "at_segment", *(f"key{i}" for i in range(len(self.keys)))}
        clash = sorted(own & {c.lower() for c in self.columns})
        if clash:
            raise ValueError(f"rename the columns {clash}")

    def held(self, value: str, name: str) -> Segmented:
        """Column ``name``: the last value that is there, at or before each row."""
        self._checked()
        return self._added(self._neighbours(value).withColumn(name, F.col("before.v")), name)

    def growth(self, value: str, name: str) -> Segmented:
        """Change against the row before, both taken from the series with its gaps held at the last value."""
        self._checked()
        rows = self._neighbours(value)
        return self._added(rows.withColumn(name, F.try_divide(F.col("before.v"), F.col("earlier.v")) - 1), name)

    def gaps_filled(self, value: str, max_gap: int = 2, long_gaps: bool = True, fill_trailing: bool = True) -> Segmented:
        """``gap_rows``, ``{value}_filled`` and ``fill_kind`` (observed, short, long, missing), gaps on a line by row position."""
        self._checked()
        rows, p, n = self._neighbours(value), F.col("before"), F.col("after")
        gap = F.when(F.col(value).isNull(), F.coalesce(n.row, F.col("total") + 1) - F.coalesce(p.row, F.lit(0)) - 1).otherwise(F.lit(0)).cast("long")
        line = p.v + (n.v - p.v) * (F.col("row") - p.row) / F.nullif(n.row - p.row, F.lit(0))
        line = F.coalesce(F.col(value), line, F.when(n.isNull(), p.v) if fill_trailing else F.lit(None))
        short = (gap > 0) & (gap <= max_gap)
        filled = F.when(gap == 0, F.col(value)).when(short | F.lit(long_gaps), line)
        kind = F.when(gap == 0, "observed").when(filled.isNull(), "missing").when(short, "short").otherwise("long")
        return self._added(rows.withColumns({"gap_rows": gap, f"{value}_filled": filled, "fill_kind": kind}), "gap_rows", f"{value}_filled", "fill_kind")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], period: str = "period", rows: int = ROWS) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its period, as :func:`windows.asof_backward` gives them."""
    side, found = free_name("side", *left.columns), free_name("found", *left.columns)
    at = free_name("at", *left.columns)
    marked = right.select(*keys, period, F.lit(0).alias(side), F.struct(*columns).alias(found))
    both = left.withColumn(side, F.lit(1)).unionByName(marked, allowMissingColumns=True).withColumn(at, F.struct(period, side))
    last = Segmented(both, keys, at, rows).held(found, found)
    return last.df.where(F.col(side) == 1).select(*(c for c in left.columns if c not in columns), *(F.col(f"{found}.{c}").alias(c) for c in columns))
