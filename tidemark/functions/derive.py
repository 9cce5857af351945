"""Derived columns: day offsets, typed parsing, recodes and substrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_offset(date: Column, year: Column) -> Column:
    """Days since 1 January of ``year``: 0 on that day, may be negative or above 365."""
    return F.datediff(date, F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


def parse_date(text: Column, pattern: str = "dd/MM/yyyy") -> Column:
    """Text to DATE; unreadable text becomes NULL."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def parse_number(text: Column, to: str = "double") -> Column:
    return text.try_cast(to)


def span(text: Column, start: int, end: int) -> Column:
    """Characters ``start`` to ``end``, both 1-based and inclusive."""
    return F.substring(text, start, end - start + 1)


def century(two_digits: Column, first_year: int = 1993) -> Column:
    """Two-digit year text to a full year at or after ``first_year``; NULL when it is no number."""
    n = two_digits.try_cast("int")
    return F.when(n >= first_year % 100, first_year // 100 * 100 + n).otherwise((first_year // 100 + 1) * 100 + n)


def last_match(default: Column, *cases: tuple[Column, Column | str]) -> Column:
    """Ordered overwrites: a later case that holds beats an earlier one."""
    out = default
    for predicate, value in cases:
        out = F.when(predicate, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def replace_where(column: Column, predicate: Column, value: Column) -> Column:
    """New value where the predicate is true, the old one elsewhere (also where it is NULL)."""
    return F.when(predicate, value).otherwise(column)
