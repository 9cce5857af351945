"""Ledgers kept as tables against the same rules as steps."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.operators.ledger import Rule, ZeroFill, apply_ledger
from tidemark.operators.rule_tables import apply_table
from tidemark.operators.seeding import Layout
from tests_tables import obs, plain, table  # noqa: F401

AT = Layout()
BATCHES = [f"{y}_{c}_WILD_2n_AR" for y in (2010, 2011) for c in ("N0", "J1")]
DAYS = ["2011-03-01", "2011-04-01", "2011-05-01"]


def observations(spark, count=600, seed=1):
    rng = random.Random(seed)
    return table(spark, [obs(rng.choice(BATCHES), rng.choice("STU"), rng.choice(DAYS), rng.choice(["1", "2", "3", None]),
                             rng.choice([AT.alive, AT.dead, AT.total]), rng.choice([1, 2, 5, 9])) for _ in range(count)])


def as_table(spark, rules):
    """Rules in the layout of a table; ``seq`` is their order."""
    rows = []
    for seq, r in enumerate(rules):
        op, names = r.bag
        rows.append({
            "seq": seq, "action": r.action, "batch": list(r.batch) or None, "site": list(r.site) or None,
            "not_site": list(r.not_site) or None, "class_age": r.class_age, "campaign": r.campaign,
            "campaign_before": r.campaign_before, "param": r.param, "not_param": r.not_param, "bag_op": op, "bags": list(names) or None,
            "on": [dt.date.fromisoformat(d) for d in r.on] or None, "after": r.after and dt.date.fromisoformat(r.after),
            "values": list(r.values) or None, "not_values": list(r.not_values) or None, "below": r.below, "first_day": r.first_day,
            "sets": [{k: None if v is None else str(v) for k, v in s.items()} for s in r.sets] or None, "stage": r.stage})
    fields = spark.createDataFrame([], ledger.RULE_TABLE + ", stage int").schema
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], fields)


def random_rule(rng, action):
    some = lambda items: tuple(rng.sample(items, rng.randint(1, 2))) if rng.random() < 0.6 else ()
    maybe = lambda value: value if rng.random() < 0.25 else None
    bag = rng.choice([(ledger.ANY_BAG, ()), (ledger.IN, ("1", "2")), (ledger.NAMED_NOT_IN, ("1",)), (ledger.UNNAMED, ()),
                      (ledger.IN_OR_UNNAMED, ("2",)), (ledger.NOT_IN_OR_UNNAMED, ("1", "3"))])
    sets = ({"id_ind": "7"}, {"value": 3.5, "date": "2011-06-01"}) if action in ("copy", "replace") else ({"value": 4.0},)
    return Rule(action, batch=some(BATCHES), site=some(list("STU")), not_site=rng.choice([(), (), ("S",)]), class_age=maybe("N0"),
                campaign=maybe(2011), campaign_before=maybe(2011), param=maybe(AT.alive), not_param=maybe(AT.total), bag=bag,
                on=some(DAYS), after=maybe("2011-03-01"), values=rng.choice([(), (), (1.0, 5.0)]), not_values=rng.choice([(), (), (9.0,)]),
                below=maybe(5.0), sets=() if action == "delete" else sets)


def test_every_condition_acts_as_in_a_step(spark):
    rng = random.Random(3)
    df = observations(spark).cache()
    for _ in range(6):
        rules = [random_rule(rng, rng.choice(["delete", "delete", "copy", "replace", "update"])) for _ in range(3)]
        assert plain(apply_table(df, as_table(spark, rules), AT)) == plain(apply_ledger(df, rules, AT))


def test_rules_of_a_stage_see_the_rows_before_it(spark):
    df = observations(spark)
    rules = [Rule("delete", site=("S",), bag=(ledger.IN, ("1",)), stage=1),
             Rule("copy", site=("S",), bag=(ledger.IN, ("2",)), sets=({"id_ind": "1"},), stage=1),
             Rule("replace", site=("T",), param=AT.dead, sets=({"site": "S", "id_ind": "1"}, {"id_ind": None}), stage=1),
             Rule("delete", site=("S",), bag=(ledger.IN, ("1",)), on=("2011-04-01",), stage=2)]
    got = plain(apply_table(df, as_table(spark, rules), AT))
    rows = Counter()
    for b, s, d, i, p, v in plain(df).elements():
        if s == "S" and i == "1":
            continue
        new = [(b, s, d, i, p, v)]
        if s == "S" and i == "2":
            new.append((b, s, d, "1", p, v))
        if s == "T" and p == AT.dead:
            new = [(b, "S", d, "1", p, v), (b, s, d, None, p, v)]
        rows.update(r for r in new if not (r[1] == "S" and r[3] == "1" and r[2] == "2011-04-01"))
    assert got == rows


def test_overlapping_edits_fail(spark):
    df = observations(spark)
    edit = dict(sets=({"value": 1.0},), stage=1)
    for other in (Rule("update", site=("S",), below=100.0, **edit), Rule("update", site=("S",), param=AT.alive, **edit)):
        with pytest.raises(Exception, match="share keys|overlap on a row"):
            apply_table(df, as_table(spark, [Rule("update", site=("S", "T"), **edit), other]), AT).collect()
    with pytest.raises(Exception, match="not among the observations"):
        few = Layout(carried=("campaign",))
        apply_table(df.drop("class_age"), as_table(spark, [Rule("delete", site=("S",), class_age="N0")]), few).collect()


def test_fills_and_rules_without_keys_are_steps(spark):
    df = observations(spark)
    rules = [Rule("delete", site=("S",), stage=1), Rule("delete", below=2.0, stage=2), Rule("update", bag=(ledger.UNNAMED, ()),
             sets=({"id_ind": "x"},), stage=4)]
    with_fill = as_table(spark, rules).unionByName(spark.createDataFrame([(9, "zero fill", 3)], "seq int, action string, stage int"),
                                                   allowMissingColumns=True)
    steps = [rules[0], rules[1], ZeroFill(), rules[2]]
    assert plain(apply_table(df, with_fill, AT)) == plain(apply_ledger(df, steps, AT))
    empty = spark.createDataFrame([], ledger.STEP_TABLE)
    assert plain(apply_table(df, empty, AT)) == plain(df)
    assert apply_table(df.limit(0), with_fill, AT).count() == 0


def test_twenty_thousand_rules_are_one_join(spark):
    rules = spark.range(20_000).selectExpr(
        "int(id) AS seq", "'delete' AS action", "array(concat('b', id)) AS batch", "array('S', 'T') AS site", "1 AS stage",
        "'not in' AS bag_op", "array('1') AS bags")
    df = observations(spark).withColumn("batch", F.when(F.col("site") == "S", F.lit("b77")).otherwise(F.col("batch")))
    out = apply_table(df, rules, AT)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("LeftAnti", plan)) == 1 and "b77" not in plan.split("LeftAnti")[0] and len(plan) < 20_000
    kept = plain(out)
    assert kept == Counter({r: n for r, n in plain(df).items() if not (r[1] == "S" and r[3] not in (None, "1"))})
