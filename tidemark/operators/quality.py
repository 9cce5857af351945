"""Audit tables that show which groups need a correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.derive import day_offset
from tidemark.functions.nulls import distinct_count_with_null, is_true, ratio
from tidemark.operators.joins import join_keys
from tidemark.operators.reshape import pivot_counts, pivot_values


def audit_counts(df: DataFrame, keys: list[str], param: str, left: str, right: str) -> DataFrame:
    """Rows of two parameters per visit and the sign of ``left - right``.

    ``status`` is ``fewer``, ``equal``, ``more``, or ``missing`` when one of the two never occurs.
    """
    counts = pivot_counts(df.filter(F.col(param).isin(left, right)), keys, param, [left, right])
    difference = F.col(left) - F.col(right)
    status = (
        F.when(difference.isNull(), "missing").when(difference < 0, "fewer")
        .when(difference > 0, "more").otherwise("equal")
    )
    return counts.withColumn("difference", difference).withColumn("status", status)


def late_jumps(df: DataFrame, bag: list[str], date: str, param: str, value: str, alive: str, total: str,
               end_month: int = 10, max_gap: int = 40, low: float = 75.0, high: float = 125.0) -> DataFrame:
    """Bags whose mean mass jumps between their last two visits late in the year.

    The last visits are taken over all parameters; both must have a mass.
    """
    visits = pivot_values(df, [*bag, date], param, value, [alive, total]).withColumn(
        "__mass", ratio(F.col(total), F.col(alive)))
    latest = Window.partitionBy(*bag).orderBy(F.col(date).desc())
    pair = (
        visits.withColumn("__r", F.row_number().over(latest)).filter(F.col("__r") <= 2)
        .groupBy(*bag).agg(
            F.max(F.when(F.col("__r") == 1, F.col(date))).alias("last_date"),
            F.max(F.when(F.col("__r") == 1, F.col("__mass"))).alias("last_mass"),
            F.max(F.when(F.col("__r") == 2, F.col(date))).alias("second_last_date"),
            F.max(F.when(F.col("__r") == 2, F.col("__mass"))).alias("second_last_mass"),
        )
    )
    change = ratio(F.col("last_mass") * 100, F.col("second_last_mass"))
    return (
        pair.withColumn("change", change)
        .filter(F.month("last_date") >= end_month)
        .filter(F.datediff("last_date", "second_last_date") < max_gap)
        .filter((F.col("change") > high) | (F.col("change") < low))
    )


def bag_continuity(df: DataFrame, keys: list[str], bag: str, date: str, year: str) -> DataFrame:
    """Distinct bags per visit against the day offset; an unnamed bag counts as one."""
    return df.groupBy(*keys, date, year).agg(distinct_count_with_null(bag).alias("n_bags")).withColumn(
        "offset", day_offset(F.col(date), F.col(year)))


def visit_screen(df: DataFrame, keys: list[str], date: str, above: int = 0, below: int | None = None,
                 first_month_after: int | None = None) -> DataFrame:
    """Groups whose row count lies strictly between two bounds and/or whose first day is late."""
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"))
    seen = seen.filter(F.col("n") > above)
    if below is not None:
        seen = seen.filter(F.col("n") < below)
    if first_month_after is not None:
        seen = seen.filter(F.month("first_date") > first_month_after)
    return seen


def stack_measures(df: DataFrame, keys: list[str], measures: dict[str, tuple], value: str = "mean_mass",
                   name: str = "measure") -> DataFrame:
    """One row per key and measure, of the measures (a value and a test) whose test holds."""
    rows = [F.when(is_true(test), F.struct(column.alias(value), F.lit(label).alias(name)))
            for label, (column, test) in measures.items()]
    return df.select(*keys, F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def unmatched_codes(df: DataFrame, lookup: DataFrame, column: str) -> DataFrame:
    """Codes of ``column`` that the lookup table does not translate, with their row counts."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return join_keys(counts, lookup.select(column), [column], "left_anti")
