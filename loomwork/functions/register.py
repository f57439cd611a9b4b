"""SQL-callable forms of the engine's functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.matching import indel


def register_functions(spark: SparkSession) -> list[str]:
    """Register them in the session; returns their names.

    ``safe_ratio``, ``vsic_division``, ``quarter_end`` are SQL functions that the optimizer inlines; ``indel_ratio`` is a
    vectorized Python function; ``step_hold`` and ``walk_forward_splits`` are table functions.
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION safe_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN try_divide(a, b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vsic_division(code STRING) RETURNS STRING RETURN substring(code, 1, 2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quarter_end(y INT, q INT) RETURNS DATE RETURN last_day(make_date(y, q * 3, 1))")

    def ratios(a, b):
        import pandas as pd

        return pd.Series([indel(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    spark.udf.register("indel_ratio", F.pandas_udf(ratios, "double"))

    @F.udtf(returnType="month DATE")
    class StepHold:
        def eval(self, start, months: int) -> Iterator[tuple]:
            if start is None or months is None:
                return
            for i in range(months):
                y, m = divmod(start.year * 12 + start.month - 1 + i, 12)
                yield (start.replace(year=y, month=m + 1, day=1),)

    @F.udtf(returnType="fold INT, train_rows INT, test_first INT, test_rows INT")
    class WalkForwardSplits:
        def eval(self, n: int, min_train: int, test_size: int, step: int) -> Iterator[tuple]:
            for fold, origin in enumerate(range(min_train, n - test_size + 1, step)):
                yield fold, origin, origin, test_size

    spark.udtf.register("step_hold", StepHold)
    spark.udtf.register("walk_forward_splits", WalkForwardSplits)
    return ["safe_ratio", "vsic_division", "quarter_end", "indel_ratio", "step_hold", "walk_forward_splits"]
