"""Back-filling of missing first visits.

Each fill reads its rows once more than the table itself: the rows to add are computed from counts
per bag and day and are then appended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import is_true
from tidemark.operators.joins import join_keys
from tidemark.operators.rows import repeat_rows


@dataclass(frozen=True)
class Layout:
    """Column names of a long observation table."""

    group: tuple[str, ...] = ("batch", "site")
    bag: str = "id_ind"
    date: str = "date"
    param: str = "code_param"
    value: str = "value"
    carried: tuple[str, ...] = ("class_age", "campaign")
    alive: str = "INDVVIVNB"
    dead: str = "INDVMORNB"
    total: str = "TOTVIVPOI"
    single: str = "INDVPOID"

    @property
    def bag_keys(self) -> list[str]:
        return [*self.group, self.bag]

    @property
    def columns(self) -> list[str]:
        return [*self.group, *self.carried, self.date, self.bag, self.param, self.value]


def zero_fill_rows(df: DataFrame, at: Layout) -> DataFrame:
    """Dead-count rows of value 0 on the group's first day, for bags first counted dead later."""
    is_dead = F.col(at.param) == at.dead
    bags = df.groupBy(*at.bag_keys).agg(
        F.min(at.date).alias("__any"), F.min(F.when(is_dead, F.col(at.date))).alias(at.date))
    # both readers of `bags` need both of its columns, so the planner shares one shuffle between them
    starts = bags.groupBy(*at.group).agg(F.min("__any").alias("__start"), F.max(at.date).alias("__dead")).filter(
        F.col("__dead").isNotNull()).drop("__dead")
    late = join_keys(bags, starts, list(at.group)).filter(
        (F.col(at.date) != F.col("__start")) & (F.col("__any") >= F.col("__start"))).drop("__any")
    copied = join_keys(df.filter(is_dead), late, [*at.bag_keys, at.date])
    return copied.withColumn(at.date, F.col("__start")).withColumn(
        at.value, F.lit(0).cast(df.schema[at.value].dataType)).select(*df.columns)


def zero_fill(df: DataFrame, at: Layout) -> DataFrame:
    return df.unionByName(zero_fill_rows(df, at))


@dataclass(frozen=True)
class Seed:
    """A first visit to complete.

    ``scope`` selects the rows and ``fill_scope`` narrows those that get rows (both over keys and the
    carried columns), ``day`` is the seed day, and ``later_only`` takes the totals from visits after it.
    ``reach``: rules whose conditions make up the scope (see ``ledger.seed_where``); empty if unknown.
    """

    scope: Column
    day: Column
    fill_scope: Column | None = None
    later_only: bool = False
    with_dead: bool = True
    reach: tuple = ()


def seed_fill_rows(df: DataFrame, seeds: list[Seed], at: Layout) -> DataFrame:
    """Rows to add at the seed days; scopes of the seeds must not overlap.

    Alive: the dead plus alive count of the bag's first visit, where the bag's first alive day is not
    the seed day, once per alive row of that day. Dead: 0 once per first dead row of the bag within its
    site and class. All seeds are served by one aggregate.
    """
    number, day, later, dead_too, fill = (F.lit(None).cast(t) for t in ("int", "date", "boolean", "boolean", "boolean"))
    for i, s in enumerate(seeds):
        inside = is_true(s.scope)
        number = F.when(inside, F.lit(i)).otherwise(number)
        day = F.when(inside, s.day).otherwise(day)
        later = F.when(inside, F.lit(s.later_only)).otherwise(later)
        dead_too = F.when(inside, F.lit(s.with_dead)).otherwise(dead_too)
        fill = F.when(inside, F.lit(True) if s.fill_scope is None else is_true(s.fill_scope)).otherwise(fill)
    counted = df.filter(F.col(at.param).isin(at.alive, at.dead)).withColumn("__seed", number).filter(
        F.col("__seed").isNotNull())
    keys = [*at.group, *at.carried, at.bag]
    days = (
        counted.select(*keys, at.date, at.param, at.value, "__seed", day.alias("__day"), later.alias("__later"),
                       dead_too.alias("__dead"), fill.alias("__fill"))
        .groupBy(*keys, at.date, "__seed", "__day", "__later", "__dead", "__fill").agg(
            F.sum(at.value).alias("__sum"),
            F.count_if(F.col(at.param) == at.alive).alias("__alive_n"),
            F.count_if(F.col(at.param) == at.dead).alias("__dead_n"),
        )
    )
    d = F.col(at.date)
    alive_day, dead_day = (F.when(F.col(n) > 0, d) for n in ("__alive_n", "__dead_n"))
    bags = days.groupBy(*keys, "__seed", "__day", "__dead", "__fill").agg(
        F.min_by("__sum", F.when(~F.col("__later") | (d > F.col("__day")), d)).alias("__total"),
        F.min(alive_day).alias("__alive_first"), F.min_by("__alive_n", alive_day).alias("__alive_n"),
        F.min(dead_day).alias("__dead_first"), F.min_by("__dead_n", dead_day).alias("__dead_n"),
    ).filter("__fill")
    # one row per batch that used the same bag of a site: a handful
    over = Window.partitionBy(*[k for k in keys if k != at.group[0]], "__seed")
    first_dead = F.min(F.when(F.col("__dead"), F.col("__dead_first"))).over(over)
    bags = bags.withColumn("__first", first_dead)
    add_alive = (F.col("__alive_first") != F.col("__day")) & F.col("__total").isNotNull()
    alive = F.struct(F.lit(at.alive).alias(at.param), F.col("__total").cast("double").alias(at.value),
                     F.col("__alive_n").alias("__n"))
    dead = F.struct(F.lit(at.dead).alias(at.param), F.lit(0.0).alias(at.value), F.col("__dead_n").alias("__n"))
    new = F.array(F.when(add_alive, alive), F.when(F.col("__dead_first") == F.col("__first"), dead))
    added = bags.select(*keys, F.col("__day").alias(at.date), F.inline(F.filter(new, lambda r: r.isNotNull())))
    rows = repeat_rows(added, "__n")
    return rows.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in at.columns])


def seed_fill(df: DataFrame, seeds: list[Seed], at: Layout) -> DataFrame:
    return df.unionByName(seed_fill_rows(df, seeds, at), allowMissingColumns=True)
