"""A ledger that stays a table: rules of any number, matched by hash.

Each rule's lists (batches, sites, named bags, days, values) are taken apart, so that one row of the relation names one value
or none for each key column. Rows that name the same columns form a pattern; each pattern of a stage is one equi-join on just
those columns, the other conditions of the rule are checked on the pairs that meet. Only the patterns are read to build the
plan, of which there are at most 256 in a stage, never the rules.

The rules of a stage are independent of each other: they all see the rows as they were before the stage, deletes first. Two
editing rules of a stage that name the same keys, or reach the same row by different keys, fail the run. Stages, and rules
that name no key or the first day of what they touch, are steps of the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import ledger
from tidemark.operators.ledger import ANY_BAG, IN, IN_OR_UNNAMED, NAMED_NOT_IN, NOT_IN_OR_UNNAMED, SEED_FILL, UNNAMED, ZERO_FILL
from tidemark.operators.seeding import Layout

KEYS = ("batch", "site", "class_age", "campaign", "param", "bag", "on", "values")
_EDITS = ("copy", "replace", "update")
_OTHER = ("not_site", "campaign_before", "not_param", "bag_op", "bags", "after", "not_values", "below")


def key_columns(at: Layout) -> dict[str, str]:
    """Columns of a rule that can be matched by hash, and the observation column of each."""
    names = (*at.group, "class_age", "campaign", at.param, at.bag, at.date, at.value)
    return {k: c for k, c in zip(KEYS, names) if c in at.columns}


def complete(table: DataFrame) -> DataFrame:
    """The table with every column of ``STEP_TABLE``, missing ones NULL and the stage of a rule without one its ``seq``."""
    fields = StructType.fromDDL(ledger.STEP_TABLE).fields
    out = table.select(*[(F.col(f"`{f.name}`") if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in fields])
    return out.withColumns({"stage": F.coalesce("stage", "seq"), "bag_op": F.coalesce("bag_op", F.lit(ANY_BAG)),
                            "first_day": F.coalesce("first_day", F.lit(False))})


def _in_plan(at: Layout) -> Column:
    """Rules that must be steps of the plan: fills, and those that no key or only the first day of their rows tells."""
    lists = F.concat(*[F.coalesce(F.col(f"`{c}`").cast("array<string>"), F.array()) for c in ("batch", "site", "on", "values")],
                     F.when(F.col("bag_op") == IN, F.coalesce("bags", F.array())).otherwise(F.array()))
    single = F.coalesce("class_age", "param", F.col("campaign").cast("string"))
    return F.col("action").isin(ZERO_FILL, SEED_FILL) | F.col("first_day") | ((F.size(lists) == 0) & single.isNull())


def relation(table: DataFrame, df: DataFrame, at: Layout) -> DataFrame:
    """One row per rule and combination of its listed values, in the types of the observations (``k_`` columns)."""
    keys = key_columns(at)
    out = table.withColumn("bag", F.when(F.col("bag_op") == IN, F.col("bags")))
    for name in ("batch", "site", "bag", "on", "values"):
        column = F.col(f"`{name}`")
        out = out.withColumn(f"k_{name}", F.explode_outer(F.when(F.size(column) > 0, column)))
    for name in ("class_age", "campaign", "param"):
        out = out.withColumn(f"k_{name}", F.col(name))
    out = out.withColumns({f"k_{k}": F.col(f"k_{k}").cast(df.schema[c].dataType) for k, c in keys.items()})
    lacking = [F.col(f"k_{k}").isNotNull() for k in KEYS if k not in keys]
    if lacking:
        message = F.raise_error(F.concat(F.lit("a column of this rule is not among the observations': "), F.col("seq").cast("string")))
        out = out.filter(F.when(reduce(lambda p, q: p | q, lacking), message.cast("boolean")).otherwise(F.lit(True)))
    pattern = F.concat(*[F.when(F.col(f"k_{k}").isNotNull(), "1").otherwise("0") for k in keys])
    return out.withColumn("pattern", pattern).select(
        "seq", "stage", "action", "pattern", "sets", *[F.col(c).alias(f"r_{c}") for c in _OTHER], *[f"k_{k}" for k in keys])


def _meets(keys: dict[str, str], pattern: str, df: DataFrame, at: Layout) -> Column:
    """Equality of the pattern's keys and the other conditions of a rule; NULL, like false, selects no row."""
    tests = [F.col(c) == F.col(f"k_{k}") for (k, c), named in zip(keys.items(), pattern) if named == "1"]
    batch, site = at.group
    bag, kind = F.col(at.bag), df.schema[at.bag].dataType.simpleString()
    listed = F.array_contains(F.col("r_bags").cast(f"array<{kind}>"), bag)
    tests.append(
        F.when(F.col("r_bag_op").isin(ANY_BAG, IN), True).when(F.col("r_bag_op") == UNNAMED, bag.isNull())
        .when(F.col("r_bag_op") == NAMED_NOT_IN, ~listed).when(F.col("r_bag_op") == IN_OR_UNNAMED, bag.isNull() | listed)
        .when(F.col("r_bag_op") == NOT_IN_OR_UNNAMED, bag.isNull() | ~listed))
    unless = lambda column, test: F.col(column).isNull() | test
    places = df.schema[site].dataType.simpleString()
    tests.append(unless("r_not_site", ~F.array_contains(F.col("r_not_site").cast(f"array<{places}>"), F.col(site))))
    if "campaign" in at.columns:
        tests.append(unless("r_campaign_before", F.col("campaign") < F.col("r_campaign_before")))
    tests += [unless("r_not_param", F.col(at.param) != F.col("r_not_param")), unless("r_after", F.col(at.date) > F.col("r_after")),
              unless("r_not_values", ~F.array_contains("r_not_values", F.col(at.value).cast("double"))),
              unless("r_below", F.col(at.value) < F.col("r_below"))]
    return reduce(lambda p, q: p & q, tests)


def _delete(df: DataFrame, rules: DataFrame, keys: dict[str, str], pattern: str, at: Layout) -> DataFrame:
    return df.join(rules.drop("sets", "action", "stage", "pattern", "seq"), _meets(keys, pattern, df, at), "left_anti")


def _found(df: DataFrame, rules: DataFrame, keys: dict[str, str], pattern: str, at: Layout, number: int) -> DataFrame:
    """``df`` with the edits of the one rule of the pattern that selects a row, NULL where none does."""
    named = [f"k_{k}" for k, flag in zip(keys, pattern) if flag == "1"]
    twice = F.count(F.lit(1)).over(Window.partitionBy(*named)) > 1
    clash = F.raise_error(F.concat(F.lit("editing rules of one stage share keys, among them rule "), F.col("seq").cast("string")))
    only = rules.withColumn("edit", F.when(twice, clash.cast("boolean")).otherwise(F.lit(True)))
    edit = F.struct(F.col("action"), F.col("sets"), F.col("edit").alias("sound"))
    only = only.select(edit.alias(f"__edit{number}"), *named, *[c for c in rules.columns if c.startswith("r_")])
    kept = [*df.columns, f"__edit{number}"]
    return df.join(only, _meets(keys, pattern, df, at), "left").select(*kept)


def _edited(df: DataFrame, columns: list[str], found: list[str], stage: int) -> DataFrame:
    """Rows replaced by, or kept beside, their new forms."""
    edits = F.filter(F.array(*found), lambda e: e.isNotNull())
    overlap = F.raise_error(F.lit(f"stage {stage}: editing rules overlap on a row")).cast("boolean")
    df = df.select(*columns, edits.alias("__edits")).filter(F.when(F.size("__edits") > 1, overlap).otherwise(F.lit(True)))
    edit = F.try_element_at("__edits", F.lit(1))

    def changed(one: Column) -> Column:
        return F.struct(*[F.when(F.map_contains_key(one, F.lit(c)), F.element_at(one, c).cast(df.schema[c].dataType)).otherwise(
            F.col(c)).alias(c) for c in columns])

    old = F.array(F.struct(*columns))
    new = F.transform(edit["sets"], changed)
    rows = F.when(edit.isNull(), old).when(edit["action"] == "copy", F.concat(old, new)).otherwise(new)
    return df.select(F.inline(F.when(edit.isNull() | edit["sound"], rows)))


def apply_table(df: DataFrame, table: DataFrame, at: Layout = Layout(), cut: bool = False) -> DataFrame:
    """Apply the steps of a table (``STEP_TABLE`` or part of its columns) in the order of their stages.

    ``sets`` maps column names to new values as text; a column mapped to NULL becomes NULL. Columns that a rule does not
    name keep their values.
    """
    steps = complete(table)
    in_plan = _in_plan(at)
    rules = relation(steps.filter(~in_plan), df, at)
    kinds = rules.select("stage", "pattern", F.col("action").isin(*_EDITS).alias("edits")).distinct().collect()
    few = steps.filter(in_plan)
    by_stage: dict[int, list] = {}
    for stage in sorted(r.stage for r in few.select("stage").distinct().collect()):
        by_stage[stage] = ledger.rules_from_table(few.filter(F.col("stage") == stage))
    keys, columns = key_columns(at), df.columns
    for stage in sorted({k.stage for k in kinds} | set(by_stage)):
        own = rules.filter(F.col("stage") == stage)
        part = lambda k, test: own.filter((F.col("pattern") == k.pattern) & test)  # noqa: E731, B023
        here = sorted((k for k in kinds if k.stage == stage), key=lambda k: (k.edits, k.pattern))
        for k in here:
            if not k.edits:
                df = _delete(df, part(k, F.col("action") == "delete"), keys, k.pattern, at)
        edits = [k for k in here if k.edits]
        for number, k in enumerate(edits):
            df = _found(df, part(k, F.col("action") != "delete"), keys, k.pattern, at, number)
        if edits:
            df = _edited(df, columns, [f"__edit{n}" for n in range(len(edits))], stage)
        if stage in by_stage:
            df = ledger.apply_ledger(df, by_stage[stage], at, cut)
    return df
