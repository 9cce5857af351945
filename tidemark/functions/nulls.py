"""One place for the NULL rules (keys match NULL to NULL, a NULL predicate never deletes a row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_true(predicate: Column) -> Column:
    """Three-valued predicate to a plain boolean: NULL counts as false."""
    return F.coalesce(predicate, F.lit(False))


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Delete the rows for which ``predicate`` is true; rows where it is NULL stay."""
    return df.filter(~is_true(predicate))


def same_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of all column pairs."""
    return reduce(lambda p, q: p & q, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def composite_key(*columns: str | Column, sep: str = "_", missing: str = "NA") -> Column:
    """Join the parts as text; a NULL part is spelled ``missing`` instead of vanishing."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts])


def distinct_count_with_null(column: str | Column) -> Column:
    """Distinct values of a group, NULL counted as one value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL where the denominator is 0."""
    return F.try_divide(numerator, denominator)


def mean(column: Column, strict: bool = False) -> Column:
    """Average over the known values, or NULL for a group with an unknown one when ``strict``."""
    if not strict:
        return F.avg(column)
    return F.when(F.count(column) == F.count(F.lit(1)), F.avg(column))
