"""Rates, masses and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.derive import day_offset
from tidemark.functions.nulls import is_true, mean, ratio
from tidemark.operators.joins import join_keys
from tidemark.operators.reshape import pivot_values
from tidemark.operators.selection import first_day_only_where


def count_visits(df: DataFrame, bag: list[str], date: str, param: str, value: str, dead: str, alive: str) -> DataFrame:
    """One row per bag and day that has both counts."""
    wide = pivot_values(df.filter(F.col(param).isin(dead, alive)), [*bag, date], param, value, [dead, alive])
    return wide.filter(F.col(dead).isNotNull() & F.col(alive).isNotNull())


def cumulative_rate(visits: DataFrame, bag: list[str], date: str, dead: str, alive: str,
                    rate: str = "mi", cumulative: str = "mc") -> DataFrame:
    """Rate of each visit and the cumulative rate ``1 - prod(1 - rate)`` up to it.

    ``visits`` has one row per bag and day, so a window holds at most one row per calendar day. A visit
    with neither dead nor alive has no rate and leaves the product as it was.
    """
    upto = Window.partitionBy(*bag).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rated = visits.withColumn(rate, ratio(F.col(dead), F.col(dead) + F.col(alive)))
    survival = F.product(F.lit(1.0) - F.col(rate)).over(upto)
    return rated.withColumn(cumulative, F.when(F.col(rate).isNotNull(), F.lit(1.0) - survival))


def mean_per_visit(df: DataFrame, keys: list[str], value: str, name: str, strict: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg(mean(F.col(value), strict).alias(name))


def bag_mass(df: DataFrame, bag: list[str], visit: list[str], param: str, value: str, total: str, alive: str,
             name: str = "bag_mass", strict: bool = False) -> DataFrame:
    """Total mass over alive count per bag, averaged over the bags of a visit.

    A bag with no survivor has no mean mass; it is skipped, or voids the visit when ``strict``.
    """
    keys = [*visit, *[b for b in bag if b not in visit]]
    wide = pivot_values(df.filter(F.col(param).isin(total, alive)), keys, param, value, [total, alive])
    return mean_bag_mass(wide, visit, total, alive, name, strict)


def mean_bag_mass(wide: DataFrame, visit: list[str], total: str, alive: str, name: str = "bag_mass",
                  strict: bool = False) -> DataFrame:
    """``bag_mass`` from one row per bag and day."""
    known = wide.filter(F.col(total).isNotNull() & F.col(alive).isNotNull())
    return known.groupBy(*visit).agg(mean(ratio(F.col(total), F.col(alive)), strict).alias(name))


def individual_mass(df: DataFrame, visit: list[str], date: str, value: str, where: Column,
                    first_day_only: Column, name: str = "individual_mass") -> DataFrame:
    """Mean over single individuals per visit; some groups keep their first day only."""
    means = df.filter(where).groupBy(*visit).agg(F.avg(value).alias(name))
    group = [k for k in visit if k != date]
    return first_day_only_where(means, group, date, first_day_only)


def splice(individual: DataFrame, bags: DataFrame, visit: list[str], first: str, second: str, name: str) -> DataFrame:
    """Full join of two measures of the same visits; ``first`` wins where both exist."""
    both = join_keys(bags, individual, visit, "full")
    return both.select(*visit, F.coalesce(F.col(first), F.col(second)).alias(name))


def visit_masses(total: str, alive: str, weighed: Column, singles: str, n_singles: str, mass: str = "bag_mass",
                 count: str = "n_weighed", single: str = "individual_mass") -> list[Column]:
    """Aggregates over rows of one bag and day each: mean bag mass, its number of bags, mean of the single individuals.

    Bags without a survivor count but have no mass. ``singles`` and ``n_singles`` are a bag's sum and number of individuals.
    """
    known = weighed & F.col(total).isNotNull() & F.col(alive).isNotNull()
    return [F.avg(F.when(known, ratio(F.col(total), F.col(alive)))).alias(mass), F.count_if(is_true(known)).alias(count),
            ratio(F.sum(singles), F.sum(n_singles)).alias(single)]


def spliced_mass(visits: DataFrame, group: list[str], date: str, first_day_only: Column, mass: str = "bag_mass",
                 count: str = "n_weighed", single: str = "individual_mass", name: str = "mean_mass") -> DataFrame:
    """The mass of each visit: single individuals where they count, else the bags; NULL where there is neither.

    ``visits`` has one row per visit, so the window holds a group's calendar at most. Where ``first_day_only`` holds, single
    individuals count on the first day the group has any. ``has_mass`` tells which visits were weighed at all.
    """
    first = F.min(F.when(F.col(single).isNotNull(), F.col(date))).over(Window.partitionBy(*group))
    late = is_true(first_day_only & (F.col(date) > first))
    counts = F.col(single).isNotNull() & ~late
    return visits.withColumns({
        name: F.coalesce(F.when(counts, F.col(single)), F.col(mass)), "has_mass": counts | is_true(F.col(count) > 0)}).drop(
        mass, count, single)


def rate_and_mass(visits: DataFrame, bag: list[str], visit: list[str], date: str, dead: str, alive: str,
                  masses: list[Column], rate: str = "mean_CM") -> DataFrame:
    """Mean cumulative rate and the ``masses`` (see ``visit_masses``) of each visit, from one row per bag and day.

    ``alive`` is NULL where it was not counted: 0 for the rate, and the bag is left out of the mass.
    """
    counted = visits.withColumns({"__dead": F.coalesce(dead, F.lit(0.0)), "__alive": F.coalesce(alive, F.lit(0.0))})
    rates = cumulative_rate(counted, bag, date, "__dead", "__alive", "__mi", "__mc")
    return rates.groupBy(*visit).agg(F.avg("__mc").alias(rate), *masses)


def assemble(rates: DataFrame, masses: DataFrame, sites: DataFrame, visit: list[str], site: str, date: str,
             year: Column, extra: dict[str, Column]) -> DataFrame:
    """Both indicators per visit with the derived keys, the day offset and the site's description."""
    return describe(join_keys(rates, masses, visit, "full"), sites, site, date, year, extra)


def describe(both: DataFrame, sites: DataFrame, site: str, date: str, year: Column, extra: dict[str, Column]) -> DataFrame:
    """A table of visits with the derived keys, the day offset and the site's description."""
    for name, column in extra.items():
        both = both.withColumn(name, column)
    both = both.withColumn("DOY", day_offset(F.col(date), year))
    return join_keys(both, sites, [site])
