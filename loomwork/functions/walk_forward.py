"""Walk-forward evaluation in SQL: a table function that takes a table, parted by series, and calls the user's function fold by fold.

    register_walk_forward(spark, "naive_folds", lambda values, horizon: [values[-1]] * horizon)
    SELECT * FROM naive_folds(TABLE(t) PARTITION BY series ORDER BY period, key => 'series', period => 'period', value => 'value',
                              min_train => 24, test_size => 6, step => 6, mode => 'rolling', train_rows => 24)

Its rows are (key, fold, step, period, actual, predicted). ``analyze`` reads the table's columns, so that a wrong name or setting fails before
anything runs, and gives the period the type that it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

Predict = Callable[[list[float | None], int], Sequence[float]]
NUMBERS = ("min_train", "test_size", "step", "train_rows")


def register_walk_forward(spark: SparkSession, name: str, predict: Predict) -> None:
    """A table function ``name`` whose folds are forecast by ``predict(values of the train rows, number of test rows)``.

    Folds: test rows begin at row ``min_train`` and every ``step`` rows after it; ``expanding`` folds train on all rows before
    them, ``rolling`` ones on the last ``train_rows`` (``min_train`` by default). A series is in one task, row by row; one
    that is too short has no folds. Null values reach the function as None. Rows of a null key are a series.
    """

    class WalkForward:
        @staticmethod
        def analyze(table: AnalyzeArgument, key: AnalyzeArgument, period: AnalyzeArgument, value: AnalyzeArgument, min_train: AnalyzeArgument | None = None, test_size: AnalyzeArgument | None = None, step: AnalyzeArgument | None = None, mode: AnalyzeArgument | None = None, train_rows: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument is a table: TABLE(t) PARTITION BY key ORDER BY period")
            kinds = {f.name: f.dataType for f in table.dataType.fields}
            for what, given in (("key", key), ("period", period), ("value", value)):
                if given.value not in kinds:
                    raise ValueError(f"{what} => {given.value!r} is no column of the table: {', '.join(kinds)}")
            if not isinstance(kinds[value.value], T.NumericType):
                raise ValueError(f"{value.value} is no number")
            for what, given in zip(NUMBERS, (min_train, test_size, step, train_rows), strict=True):
                if given is not None and given.value is not None and given.value < 1:
                    raise ValueError(f"{what} is at least 1")
            if mode is not None and mode.value not in ("expanding", "rolling"):
                raise ValueError("mode is expanding or rolling")
            return AnalyzeResult(T.StructType().add("key", T.StringType()).add("fold", T.IntegerType()).add("step", T.IntegerType()).add("period", kinds[period.value]).add("actual", T.DoubleType()).add("predicted", T.DoubleType()))

        def __init__(self) -> None:
            self.rows: list[tuple] = []
            self.settings: tuple | None = None

        def eval(self, table, key, period, value, min_train=24, test_size=6, step=1, mode="expanding", train_rows=None) -> None:
            self.settings = (min_train, test_size, step, mode, train_rows)
            number = table[value]
            self.rows.append((table[key], table[period], None if number is None else float(number)))

        def terminate(self) -> Iterator[tuple]:
            if self.settings is None:
                return
            min_train, test_size, every, mode, train_rows = self.settings
            values = [r[2] for r in self.rows]
            for fold, origin in enumerate(range(min_train, len(values) - test_size + 1, every)):
                first = 0 if mode == "expanding" else max(0, origin - (train_rows or min_train))
                found = [float(v) for v in predict(values[first:origin], test_size)]
                if len(found) != test_size:
                    raise ValueError(f"fold {fold}: {len(found)} predictions for {test_size} rows")
                for i, v in enumerate(found):
                    key, at, actual = self.rows[origin + i]
                    yield None if key is None else str(key), fold, i + 1, at, actual, v

    spark.udtf.register(name, udtf(WalkForward))
