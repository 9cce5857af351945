"""Long to wide, wide to long, and nested series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_keys


def pivot_values(df: DataFrame, keys: list[str], param: str, value: str, names: list) -> DataFrame:
    """One row per key, one column per parameter name; a missing cell is NULL.

    Conditional aggregates need one shuffle where ``pivot`` needs two.
    """
    cells = [F.max(F.when(F.col(param) == n, F.col(value))).alias(str(n)) for n in names]
    return df.groupBy(*keys).agg(*cells)


def pivot_cells(df: DataFrame, keys: list[str], param: str, value: str, names: list, crowded: str = "crowded") -> DataFrame:
    """``pivot_values`` with a list of the cells that hold several rows: parameter, number of rows, least and greatest value.

    One aggregate gives both, so crowded cells are set aside in the pass that resolves them.
    """
    here = [F.when(F.col(param) == n, F.col(value)) for n in names]
    cells = [F.max(h).alias(str(n)) for n, h in zip(names, here)]
    rows = [F.count_if(F.col(param) == n) for n in names]
    many = [F.when(k > 1, F.struct(F.lit(n).alias("param"), k.alias("n"), F.min(h).alias("least"), F.max(h).alias("most")))
            for n, k, h in zip(names, rows, here)]
    return df.groupBy(*keys).agg(*cells, F.array_compact(F.array(*many)).alias(crowded))


def set_aside(wide: DataFrame, keys: list[str], crowded: str = "crowded") -> DataFrame:
    """The crowded cells of ``pivot_cells``, one row each."""
    return wide.select(*keys, F.inline(crowded))


def pivot_counts(df: DataFrame, keys: list[str], param: str, names: list, other: str | None = None) -> DataFrame:
    """Rows per key and parameter; a combination that never occurs is NULL, not 0.

    ``other`` names a column for the rows of all other parameters, a missing one included.
    """
    cells = [F.nullif(F.count_if(F.col(param) == n), F.lit(0)).alias(str(n)) for n in names]
    if other is not None:
        cells.append(F.nullif(F.count(F.lit(1)) - F.count_if(F.col(param).isin(*names)), F.lit(0)).alias(other))
    return df.groupBy(*keys).agg(*cells)


def frequent_values(df: DataFrame, column: str, most: int = 100) -> list:
    """The ``most`` most frequent known values, in their order: names for ``pivot_counts``, of which the rest are ``other``."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r[0] for r in counts.orderBy(F.desc("n"), column).limit(most).collect())


def crowded_cells(df: DataFrame, keys: list[str], param: str) -> DataFrame:
    """Pivot cells that hold more than one row, with their row count."""
    return df.groupBy(*keys, param).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unpivot_measures(df: DataFrame, keys: list[str], measures: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, measures, name, value)


def nest_days(df: DataFrame, keys: list[str], day: str, columns: list[str], most: int = 10_000,
              name: str = "series") -> DataFrame:
    """Groups as arrays of (day, columns) in the order of the days: one row per group and chunk of at most ``most`` rows.

    Every row is kept, repeats too. Days are laid out by their row counts, which are summed before they are shuffled: as long
    as a chunk has room, days follow each other in it; a day of more than half a chunk's rows is dealt to ``parts`` by the
    blocks of rows it was read in, so no task holds a hot group or a hot day.
    """
    half = max(1, most // 2)
    numbered = df.withColumn("__block", F.floor(F.monotonically_increasing_id() / half))
    counts = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.col(day).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1))
    large = F.col("__n") > half
    plan = counts.select(*keys, day, large.alias("__large"), F.floor(F.coalesce(before, F.lit(0)) / half).alias("chunk"))
    part = F.when(F.col("__large"), F.col("__block")).otherwise(F.lit(-1))
    rows = join_keys(numbered, plan, [*keys, day]).withColumn("part", part)
    held = F.when(F.col("__large"), F.col(day))
    return rows.groupBy(*keys, "chunk", held.alias("__day"), "part").agg(
        F.array_sort(F.collect_list(F.struct(day, *columns))).alias(name)).drop("__day")


def unnest_days(df: DataFrame, keys: list[str], name: str = "series") -> DataFrame:
    return df.select(*keys, F.inline(name))
