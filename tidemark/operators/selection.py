"""Group bounds, rows at a bound, ranks and group gates.

Raw rows of one group may be a large part of the table, so nothing here opens a window over them:
a group is first reduced by an aggregate (combined before the shuffle) and its rows are then matched
by a join. Windows run only over inputs with one row per key and day, which the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import is_true
from tidemark.operators.joins import join_keys


def attach_bounds(df: DataFrame, keys: list[str], column: str, low: str | None = None, high: str | None = None,
                  where: Column | None = None) -> DataFrame:
    """Add the group's smallest and/or largest ``column`` to every row."""
    value = F.col(column) if where is None else F.when(where, F.col(column))
    bounds = [f(value).alias(n) for f, n in ((F.min, low), (F.max, high)) if n]
    return join_keys(df, df.groupBy(*keys).agg(*bounds), keys, "left")


def rows_at_bound(df: DataFrame, keys: list[str], column: str, last: bool = False) -> DataFrame:
    """All rows at the group's smallest (or largest) ``column`` value, ties kept."""
    bound = df.groupBy(*keys).agg((F.max if last else F.min)(column).alias(column))
    return join_keys(df, bound.filter(F.col(column).isNotNull()), [*keys, column], "left_semi")


def rows_at_nth_latest(df: DataFrame, keys: list[str], date: str, nth: int) -> DataFrame:
    """Rows on the group's ``nth`` latest distinct day."""
    days = df.select(*keys, date).filter(F.col(date).isNotNull()).distinct()
    ranked = days.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(date).desc())))
    return join_keys(df, ranked.filter(F.col("__r") == nth), [*keys, date], "left_semi")


def first_value(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Value at the group's first ``order`` position; the smallest one when several share it."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(value), F.struct(order, value))[value].alias(name))


def gate_rows(df: DataFrame, keys: list[str], min_rows: int = 0, end_month: int = 0, date: str = "date") -> DataFrame:
    """Keep whole groups with at least ``min_rows`` rows whose last day is in ``end_month`` or later."""
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(date).alias("__last"))
    good = sized.filter(F.col("__n") >= min_rows)
    if end_month:
        good = good.filter(F.month("__last") >= end_month)
    return join_keys(df, good, keys, "left_semi")


def gate_days(df: DataFrame, keys: list[str], min_rows: int = 0, end_month: int = 0, date: str = "date") -> DataFrame:
    """``gate_rows`` for an input with one row per key and day: one shuffle, no second read."""
    w = Window.partitionBy(*keys)
    keep = F.count(F.lit(1)).over(w) >= min_rows
    if end_month:
        keep &= F.month(F.max(date).over(w)) >= end_month
    return df.withColumn("__keep", keep).filter("__keep").drop("__keep")


def first_day_only_where(df: DataFrame, keys: list[str], date: str, where: Column) -> DataFrame:
    """Drop rows after the group's first day where ``where`` holds; other rows stay.

    For an input with one row per key and day, as in ``gate_days``: one shuffle, no second read.
    """
    bounded = df.withColumn("__first", F.min(date).over(Window.partitionBy(*keys)))
    return bounded.filter(~is_true(where & (F.col(date) > F.col("__first")))).drop("__first")


def gate_measures(df: DataFrame, keys: list[str], measures: dict[str, Column], min_rows: int = 0, end_month: int = 0,
                  date: str = "date") -> DataFrame:
    """``gate_days`` for several measures of one table, each gated by the rows it is present on.

    ``measures`` names a column and the condition under which the row counts for it. A measure whose group fails is NULL;
    rows that count for no measure go. One row per key and day; one shuffle for all measures.
    """
    w = Window.partitionBy(*keys)
    flags = {}
    for name, present in measures.items():
        keep = present & (F.count_if(present).over(w) >= min_rows)
        if end_month:
            keep &= is_true(F.month(F.max(F.when(present, F.col(date))).over(w)) >= end_month)
        flags["__keep_" + name] = keep
    kept = df.withColumns(flags)
    some = F.greatest(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(next(iter(flags)))
    return kept.filter(some).withColumns(
        {m: F.when(F.col("__keep_" + m), F.col(m)) for m in measures}).drop(*flags)


def best_rows(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows with the group's smallest known score, ties kept.

    The rank is limited to 1, so each task drops all but its own best rows before the shuffle.
    """
    ranked = df.filter(F.col(score).isNotNull()).withColumn(
        "__r", F.rank().over(Window.partitionBy(*keys).orderBy(score)))
    return ranked.filter(F.col("__r") == 1).drop("__r")
