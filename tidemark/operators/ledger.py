"""An ordered ledger of corrections: delete, copy, replace, update and fill steps.

Row steps need no shuffle: runs of keyed deletes become one hash anti join with a relation of known size, the others
filters and in-place row generation. Only fills aggregate; the table is read once more for each, so a lineage cut
after a fill keeps later fills from repeating the earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidemark.functions.nulls import delete_where, is_true
from tidemark.operators.joins import small_table
from tidemark.operators.rows import copy_edit, replace_rows
from tidemark.operators.seeding import Layout, Seed, seed_fill, zero_fill
from tidemark.session import cut_lineage

ANY_BAG, NAMED_NOT_IN, IN, IN_OR_UNNAMED, NOT_IN_OR_UNNAMED, UNNAMED = (
    "any", "not in", "in", "in or null", "not in or null", "null")


@dataclass(frozen=True)
class Rule:
    """One correction. An empty condition holds for every row.

    ``bag`` is a pair of an operator and bag names: ``in``, ``not in`` (unnamed bags are not selected),
    ``null`` and the two ``... or null`` forms. ``on``, ``after`` compare the date, ``values``,
    ``not_values`` and ``below`` the value. ``sets`` holds, per new row, the columns to change. Neighbouring rules with
    the same ``stage`` are meant to be independent: a row that two of them select fails the run.
    """

    action: str  # delete, copy, replace or update
    batch: tuple = ()
    site: tuple = ()
    not_site: tuple = ()
    class_age: str | None = None
    campaign: int | None = None
    campaign_before: int | None = None
    param: str | None = None
    not_param: str | None = None
    bag: tuple[str, tuple] = (ANY_BAG, ())
    on: tuple[str, ...] = ()
    after: str | None = None
    values: tuple[float, ...] = ()
    not_values: tuple[float, ...] = ()
    below: float | None = None
    first_day: bool = False
    sets: tuple[dict, ...] = ()
    stage: int | None = None

    @property
    def keyed(self) -> bool:
        """Names its batches and sites, so rows can find it by hash."""
        plain = replace(self, batch=(), site=(), param=None, bag=(ANY_BAG, ()), on=(), after=None, stage=None)
        return self.action == "delete" and bool(self.batch and self.site) and plain == Rule("delete")

    def matches(self, at: Layout) -> Column:
        """The rule as a predicate; NULL where a compared column is NULL."""
        batch, site = (F.col(c) for c in at.group)
        tests = [F.lit(True)]
        if self.batch:
            tests.append(batch.isin(*self.batch))
        if self.site:
            tests.append(site.isin(*self.site))
        if self.not_site:
            tests.append(~site.isin(*self.not_site))
        if self.class_age is not None:
            tests.append(F.col("class_age") == self.class_age)
        if self.campaign is not None:
            tests.append(F.col("campaign") == self.campaign)
        if self.campaign_before is not None:
            tests.append(F.col("campaign") < self.campaign_before)
        if self.param is not None:
            tests.append(F.col(at.param) == self.param)
        if self.not_param is not None:
            tests.append(F.col(at.param) != self.not_param)
        op, names = self.bag
        bag = F.col(at.bag)
        if op in (IN, IN_OR_UNNAMED):
            tests.append(bag.isin(*names) if op == IN else bag.isNull() | bag.isin(*names))
        elif op in (NAMED_NOT_IN, NOT_IN_OR_UNNAMED):
            tests.append(~bag.isin(*names) if op == NAMED_NOT_IN else bag.isNull() | ~bag.isin(*names))
        elif op == UNNAMED:
            tests.append(bag.isNull())
        if self.on:
            tests.append(F.col(at.date).isin(*[F.lit(d).cast("date") for d in self.on]))
        if self.after is not None:
            tests.append(F.col(at.date) > F.lit(self.after).cast("date"))
        if self.values:
            tests.append(F.col(at.value).isin(*self.values))
        if self.not_values:
            tests.append(~F.col(at.value).isin(*self.not_values))
        if self.below is not None:
            tests.append(F.col(at.value) < self.below)
        return reduce(lambda p, q: p & q, tests)

    def edits(self) -> list[dict[str, Column]]:
        return [{k: v if isinstance(v, Column) else F.lit(v) for k, v in s.items()} for s in self.sets]


def seed_where(conditions: Sequence[Rule], day: Column, at: Layout = Layout(), **flags: bool) -> Seed:
    """A seed whose scope is given by conditions on keys (their action does not count), so that schedules know its reach."""
    for c in conditions:
        if c.param or c.not_param or c.on or c.after or c.values or c.not_values or c.below is not None:
            raise ValueError("a seed's scope is over keys and carried columns")
    return Seed(reduce(lambda p, q: p | q, [is_true(c.matches(at)) for c in conditions]), day, reach=tuple(conditions), **flags)


@dataclass(frozen=True)
class ZeroFill:
    """Add the missing zero counts on the group's first day."""


@dataclass(frozen=True)
class SeedFill:
    """Complete first visits; the seeds of one step are independent of each other."""

    seeds: tuple[Seed, ...] = field(default_factory=tuple)


Step = Rule | ZeroFill | SeedFill


RULE_TABLE = """seq int, action string, batch array<string>, site array<string>, not_site array<string>,
    class_age string, campaign int, campaign_before int, param string, not_param string, bag_op string,
    bags array<string>, `on` array<date>, after date, `values` array<double>, not_values array<double>,
    below double, first_day boolean, sets array<map<string,string>>"""
#: With the further columns that stages and fills need; ``scope``, ``day`` and ``fill_scope`` are SQL expressions.
STEP_TABLE = RULE_TABLE + """, stage int, scope string, day string, fill_scope string, later_only boolean,
    with_dead boolean"""
ZERO_FILL, SEED_FILL = "zero fill", "seed fill"


def _seed(row: dict) -> Seed:
    scopes = {k: F.expr(row[k]) for k in ("day", "fill_scope") if k in row}
    flags = {k: row[k] for k in ("later_only", "with_dead") if k in row}
    return Seed(F.expr(row.get("scope", "true")), **scopes, **flags)


def rules_from_table(table: DataFrame) -> list[Step]:
    """Steps kept as a table of the ``RULE_TABLE`` or ``STEP_TABLE`` layout, in the order of ``seq``.

    Neighbouring ``seed fill`` rows of one ``stage`` are the seeds of one step; those without a stage are steps of their own.

    Every rule becomes part of the plan, so all of them are read, whatever their number; bulk deletes that should stay a table
    belong into ``anti_rules``.
    """
    rows = table.orderBy("seq").collect()
    rules: list[Step] = []
    open_fill = None
    for row in rows:
        given = {k: v for k, v in row.asDict().items() if v is not None}
        given.pop("seq")
        if given["action"] == SEED_FILL:
            stage = given.get("stage")
            if stage is not None and stage == open_fill:
                rules[-1] = SeedFill((*rules[-1].seeds, _seed(given)))
            else:
                rules.append(SeedFill((_seed(given),)))
            open_fill = stage
            continue
        open_fill = None
        if given["action"] == ZERO_FILL:
            rules.append(ZeroFill())
            continue
        bag = (given.pop("bag_op", ANY_BAG), tuple(given.pop("bags", ())))
        days = {k: str(v) if k == "after" else tuple(map(str, v)) for k, v in given.items() if k in ("on", "after")}
        lists = {k: tuple(v) for k, v in given.items() if isinstance(v, list) and k not in days}
        rules.append(Rule(**{**given, **lists, **days, "bag": bag}))
    return rules


def rule_table(df: DataFrame, rules: Sequence[Rule], at: Layout) -> DataFrame:
    """Keyed delete rules as a table, one row per batch and site."""
    text = pa.string()
    schema = pa.schema([*((c, text) for c in ("batch", "site", "param", "op", "after")),
                        ("bags", pa.list_(text)), ("days", pa.list_(text))])
    rows = [
        {"batch": str(b), "site": str(s), "param": r.param, "op": r.bag[0], "bags": [str(v) for v in r.bag[1]],
         "days": list(r.on) or None, "after": r.after}
        for r in rules for b in r.batch for s in r.site
    ]
    kinds = [df.schema[c].dataType for c in at.group]
    return small_table(df.sparkSession, rows, schema).select(
        F.col("batch").cast(kinds[0]).alias("r_batch"), F.col("site").cast(kinds[1]).alias("r_site"),
        F.col("param").alias("r_param"), F.col("op").alias("r_op"),
        F.col("bags").cast(ArrayType(df.schema[at.bag].dataType)).alias("r_bags"),
        F.col("days").cast("array<date>").alias("r_days"), F.col("after").cast("date").alias("r_after"))


def delete_keyed(df: DataFrame, rules: Sequence[Rule], at: Layout) -> DataFrame:
    """All rows matched by none of the keyed delete rules: one hash lookup per row, however many rules."""
    bag, day = F.col(at.bag), F.col(at.date)
    named_in = F.array_contains("r_bags", bag)
    bag_test = (
        F.when(F.col("r_op") == ANY_BAG, True).when(F.col("r_op") == UNNAMED, bag.isNull())
        .when(F.col("r_op") == IN, named_in).when(F.col("r_op") == NAMED_NOT_IN, ~named_in)
        .when(F.col("r_op") == IN_OR_UNNAMED, bag.isNull() | named_in)
        .when(F.col("r_op") == NOT_IN_OR_UNNAMED, bag.isNull() | ~named_in)
    )
    batch, site = at.group
    condition = (
        (F.col(batch) == F.col("r_batch")) & (F.col(site) == F.col("r_site"))
        & (F.col("r_param").isNull() | (F.col("r_param") == F.col(at.param)))
        & is_true(bag_test)
        & (F.col("r_days").isNull() | is_true(F.array_contains("r_days", day)))
        & (F.col("r_after").isNull() | is_true(day > F.col("r_after")))
    )
    return df.join(rule_table(df, rules, at), condition, "left_anti")


def _apply_rule(df: DataFrame, rule: Rule, at: Layout) -> DataFrame:
    hit = rule.matches(at)
    if rule.first_day:
        # the first day among the rows the rule touches, all parameters
        touched = replace(rule, param=None, first_day=False).matches(at)
        first = df.filter(touched).agg(F.min(at.date)).scalar()
        everything, hit = touched, hit & (F.col(at.date) == first)
        if rule.action == "replace":
            return delete_where(replace_rows(df.withColumn("__hit", is_true(hit)), F.col("__hit"), rule.edits()),
                                ~F.col("__hit") & everything).drop("__hit")
    if rule.action == "delete":
        return delete_where(df, hit)
    if rule.action == "copy":
        return copy_edit(df, [(hit, e) for e in rule.edits()])
    if rule.action == "replace":
        return replace_rows(df, hit, rule.edits())
    if rule.action == "update":
        (edit,) = rule.edits()
        touched = is_true(hit)
        return df.withColumns({c: F.when(touched, v.cast(df.schema[c].dataType)).otherwise(F.col(c))
                               for c, v in edit.items()})
    raise ValueError(f"unknown action {rule.action!r}")


def require_independent(df: DataFrame, rules: Sequence[Rule], at: Layout) -> DataFrame:
    """``df``, failing when it is read if a row is selected by two or more of the rules."""
    hits = sum((is_true(r.matches(at)).cast("int") for r in rules), F.lit(0))
    message = F.concat(F.lit(f"stage {rules[0].stage}: rules overlap on "), F.concat_ws(" ", *[
        F.col(c).cast("string") for c in (*at.group, at.bag, at.date, at.param)]))
    return df.filter(F.when(hits > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def apply_ledger(df: DataFrame, steps: Sequence[Step], at: Layout = Layout(), cut: bool = False) -> DataFrame:
    """Apply the steps in order. ``cut`` writes a checkpoint after each fill that has steps behind it.

    Each run of rules with the same ``stage`` is checked against the rows before it (see ``Rule``).
    """
    pending: list[Rule] = []

    def flush(frame: DataFrame) -> DataFrame:
        if not pending:
            return frame
        out = delete_keyed(frame, pending, at)
        pending.clear()
        return out

    stage = None
    for i, step in enumerate(steps):
        before, stage = stage, step.stage if isinstance(step, Rule) else None
        if stage is not None and stage != before:
            run = list(takewhile(lambda s: isinstance(s, Rule) and s.stage == stage, steps[i:]))
            if len(run) > 1:
                df = require_independent(flush(df), run, at)
        if isinstance(step, Rule) and step.keyed:
            pending.append(step)
            continue
        df = flush(df)
        if isinstance(step, Rule):
            df = _apply_rule(df, step, at)
            continue
        df = zero_fill(df, at) if isinstance(step, ZeroFill) else seed_fill(df, list(step.seeds), at)
        if cut and i < len(steps) - 1:
            df = cut_lineage(df)
    return flush(df)


def rule_hits(df: DataFrame, rules: Sequence[Rule], at: Layout = Layout()) -> DataFrame:
    """Rows each rule selects in ``df``, from one pass."""
    counts = df.agg(*[F.count_if(is_true(r.matches(at))).alias(str(i)) for i, r in enumerate(rules)])
    return counts.unpivot([], [str(i) for i in range(len(rules))], "rule", "n").withColumn(
        "rule", F.col("rule").cast("int"))


def rule_conflicts(df: DataFrame, rules: Sequence[Rule], at: Layout = Layout()) -> DataFrame:
    """Rows that two or more rules meant to be independent would touch, with the rule numbers."""
    hits = F.array(*[F.when(is_true(r.matches(at)), F.lit(i)) for i, r in enumerate(rules)])
    return df.withColumn("rules", F.filter(hits, lambda h: h.isNotNull())).filter(F.size("rules") > 1)

