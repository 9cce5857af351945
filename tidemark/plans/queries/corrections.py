"""Back-fills and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledger, rule_tables, seeding
from tidemark.operators.ledger import Rule, SeedFill, ZeroFill, seed_where
from tidemark.operators.schedule import apply_scheduled
from tidemark.operators.seeding import Seed
from tidemark.plans.queries import base
from tidemark.plans.queries.registry import SQL, query
from tidemark.sources import tables

AT = tables.AT

ZERO_ROWS = """zero_rows AS (
  SELECT o.batch, o.site, o.campaign, s.start AS date, o.id_ind, o.code_param, 0.0::DOUBLE AS value
  FROM (SELECT *, min(date) OVER (PARTITION BY batch, site, id_ind) AS first_dead FROM obs WHERE code_param = 'dead') o
  JOIN (SELECT batch, site, min(date) AS start FROM obs GROUP BY ALL) s USING (batch, site)
  WHERE o.date = first_dead AND first_dead <> s.start)"""


def _seed_rows(source: str, day: str, scope: str = "true", later: bool = False, dead: bool = True, name: str = "seed_rows") -> str:
    total_scope = f"date > {day}" if later else "true"
    dead_rows = f"""
  UNION ALL
  SELECT batch, site, campaign, {day} AS date, id_ind, 'dead', 0.0
  FROM (SELECT *, min(date) OVER (PARTITION BY site, campaign, id_ind) AS f FROM {source} WHERE code_param = 'dead' AND {scope})
  WHERE date = f""" if dead else ""
    return f"""{name} AS (
  SELECT a.batch, a.site, a.campaign, {day} AS date, a.id_ind, 'alive' AS code_param, t.total AS value
  FROM (SELECT *, min(date) OVER (PARTITION BY batch, site, id_ind) AS f FROM {source}
        WHERE code_param = 'alive' AND {scope}) a
  JOIN (SELECT batch, site, id_ind, sum(value) AS total FROM (
          SELECT *, min(date) OVER (PARTITION BY batch, site, id_ind) AS f FROM {source}
          WHERE code_param IN ('alive', 'dead') AND {scope} AND {total_scope}) WHERE date = f GROUP BY ALL) t
    ON a.batch = t.batch AND a.site = t.site AND a.id_ind IS NOT DISTINCT FROM t.id_ind
  WHERE a.date = f AND f <> {day}{dead_rows})"""


_COLUMNS = "batch, site, campaign, date, id_ind, code_param, value"


@query(f"WITH {base.OBS}, {ZERO_ROWS} SELECT * REPLACE (round(value, 4) AS value) FROM obs UNION ALL SELECT {_COLUMNS} FROM zero_rows")
def seed_zero_fill(spark, folder):
    return seeding.zero_fill(tables.shipments(spark, folder), AT).withColumn("value", F.round("value", 4))


@query(f"""
WITH {base.OBS}, {_seed_rows('obs', 'make_date(campaign, 2, 1)', later=True, dead=False)}
SELECT {_COLUMNS} FROM seed_rows""")
def seed_alive_fill(spark, folder):
    seed = Seed(F.lit(True), F.make_date(F.col("campaign"), F.lit(2), F.lit(1)), later_only=True, with_dead=False)
    return seeding.seed_fill_rows(tables.shipments(spark, folder), [seed], AT).select(*_COLUMNS.split(", "))


@query(f"""
WITH {base.OBS}, {_seed_rows('obs', 'make_date(campaign, 1, 1)')}
SELECT {_COLUMNS} FROM seed_rows WHERE code_param = 'dead'""")
def seed_dead_fill(spark, folder):
    seed = Seed(F.lit(True), F.make_date(F.col("campaign"), F.lit(1), F.lit(1)))
    rows = seeding.seed_fill_rows(tables.shipments(spark, folder), [seed], AT)
    return rows.filter("code_param = 'dead'").select(*_COLUMNS.split(", "))


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, flag, quantity FROM lines
WHERE NOT coalesce(batch BETWEEN 1996 AND 1999 AND flag = 'R'
                   AND concat_ws('_', flag, coalesce(id_ind::VARCHAR, 'NA')) <> 'R_NA', false)""")
def batch_scope(spark, folder):
    from tidemark.functions.nulls import composite_key, delete_where
    lines = tables.shipment_lines(spark, folder).select("batch", "site", "id_ind", "flag", "quantity")
    foreign = F.col("batch").between(1996, 1999) & (F.col("flag") == "R") & (composite_key("flag", "id_ind") != "R_NA")
    return delete_where(lines, foreign)


def _rules() -> list:
    return [
        Rule("delete", batch=(1996,), site=(3,)),
        ZeroFill(),
        Rule("delete", batch=(1995, 1997), site=(5, 7), param="dead", bag=(ledger.NAMED_NOT_IN, (1,))),
        Rule("delete", batch=(1998,), site=(1, 2), bag=(ledger.UNNAMED, ())),
        Rule("delete", batch=(1999,), site=(4,), bag=(ledger.NOT_IN_OR_UNNAMED, (1, 2))),
        Rule("delete", batch=(2000,), site=(6,), param="dead", bag=(ledger.IN, (2, 3)), after="2000-06-15"),
        Rule("delete", batch=(1995,), bag=(ledger.IN, (5,)), not_values=(10.0, 20.0)),
        Rule("copy", campaign=1997, param="dead", bag=(ledger.IN, (6,)), on=("1997-03-01",),
             sets=({"code_param": "alive", "value": 300.0},)),
        Rule("replace", batch=(1998,), param="mass", bag=(ledger.IN, (7,)), on=("1998-05-01", "1998-06-01"),
             sets=({"id_ind": 8}, {"id_ind": 9, "value": 1.5})),
        SeedFill((
            Seed(F.col("campaign") == 1999, F.lit("1999-01-01").cast("date")),
            Seed((F.col("campaign") == 2000) & (F.col("site") != 6), F.lit("2000-02-01").cast("date"), later_only=True,
                 with_dead=False),
        )),
        Rule("delete", campaign_before=1996, param="mass"),
        Rule("update", bag=(ledger.UNNAMED, ()), sets=({"id_ind": -1},)),
    ]


@query(f"""
WITH {base.OBS.replace(', obs AS (', ', obs0 AS (')},
obs AS (SELECT * FROM obs0 WHERE NOT (batch = 1996 AND site = 3)),
{ZERO_ROWS},
s1 AS (SELECT * FROM obs UNION ALL SELECT {_COLUMNS} FROM zero_rows),
s2 AS (
  SELECT * FROM s1
  WHERE NOT coalesce(batch IN (1995, 1997) AND site IN (5, 7) AND code_param = 'dead' AND id_ind <> 1, false)
    AND NOT (batch = 1998 AND site IN (1, 2) AND id_ind IS NULL)
    AND NOT (batch = 1999 AND site = 4 AND (id_ind IS NULL OR id_ind NOT IN (1, 2)))
    AND NOT coalesce(batch = 2000 AND site = 6 AND code_param = 'dead' AND id_ind IN (2, 3) AND date > DATE '2000-06-15', false)
    AND NOT coalesce(batch = 1995 AND id_ind = 5 AND value NOT IN (10.0, 20.0), false)),
s3 AS (
  SELECT * FROM s2
  UNION ALL
  SELECT batch, site, campaign, date, id_ind, 'alive', 300.0 FROM s2
  WHERE campaign = 1997 AND code_param = 'dead' AND id_ind = 6 AND date = DATE '1997-03-01'),
s4 AS (
  SELECT *, coalesce(batch = 1998 AND code_param = 'mass' AND id_ind = 7 AND date IN (DATE '1998-05-01', DATE '1998-06-01'),
                     false) AS hit FROM s3),
s5 AS (
  SELECT {_COLUMNS} FROM s4 WHERE NOT hit
  UNION ALL SELECT batch, site, campaign, date, 8, code_param, value FROM s4 WHERE hit
  UNION ALL SELECT batch, site, campaign, date, 9, code_param, 1.5 FROM s4 WHERE hit),
{_seed_rows('s5', "DATE '1999-01-01'", 'campaign = 1999', name='f1')},
{_seed_rows('s5', "DATE '2000-02-01'", '(campaign = 2000 AND site <> 6)', later=True, dead=False, name='f2')},
s6 AS (SELECT {_COLUMNS} FROM s5 UNION ALL SELECT {_COLUMNS} FROM f1 UNION ALL SELECT {_COLUMNS} FROM f2)
SELECT batch, site, campaign, date, coalesce(id_ind, -1) AS id_ind, code_param, round(value, 4) AS value FROM s6
WHERE NOT (campaign < 1996 AND code_param = 'mass')""")
def ledger_apply(spark, folder):
    return ledger.apply_ledger(tables.shipments(spark, folder), _rules(), AT).withColumn("value", F.round("value", 4))


@query(SQL["ledger_apply"])
def ledger_scheduled(spark, folder):
    """The same corrections written as three fills with rules between them, of which two run as one."""
    *rules, _, masses, named = _rules()
    first = lambda text: F.lit(text).cast("date")
    early = SeedFill((seed_where([Rule("seed", campaign=1999)], first("1999-01-01"), AT),))
    late = SeedFill((seed_where([Rule("seed", campaign=2000, not_site=(6,))], first("2000-02-01"), AT, later_only=True, with_dead=False),))
    steps = [*rules[:2], rules[4], early, *rules[2:4], *rules[5:], late, masses, named]
    return apply_scheduled(tables.shipments(spark, folder), steps, AT, lambda batch: {"campaign": batch}).withColumn(
        "value", F.round("value", 4))


@query(f"""
WITH {base.OBS}
SELECT 0 AS rule, count(*) AS n FROM obs WHERE code_param = 'dead' AND id_ind <> 1
UNION ALL SELECT 1, count(*) FROM obs WHERE id_ind IS NULL
UNION ALL SELECT 2, count(*) FROM obs WHERE campaign < 1998 AND value < 20""")
def ledger_hits(spark, folder):
    rules = [Rule("delete", param="dead", bag=(ledger.NAMED_NOT_IN, (1,))), Rule("delete", bag=(ledger.UNNAMED, ())),
             Rule("delete", campaign_before=1998, below=20.0)]
    return ledger.rule_hits(tables.shipments(spark, folder), rules, AT)


@query(f"""
WITH {base.OBS}
SELECT batch, site, date, id_ind, code_param, round(value, 4) AS value,
       CASE WHEN code_param = 'dead' AND id_ind <> 1 THEN '0' ELSE '1' END || ',2' AS rules
FROM obs WHERE ((code_param = 'dead' AND id_ind <> 1) OR id_ind IS NULL) AND campaign < 1998 AND value < 20""")
def ledger_conflicts(spark, folder):
    rules = [Rule("delete", param="dead", bag=(ledger.NAMED_NOT_IN, (1,))), Rule("delete", bag=(ledger.UNNAMED, ())),
             Rule("delete", campaign_before=1998, below=20.0)]
    found = ledger.rule_conflicts(tables.shipments(spark, folder), rules, AT)
    return found.withColumn("value", F.round("value", 4)).withColumn("rules", F.array_join(F.col("rules").cast("array<string>"), ",")).drop("campaign")


def _rule_rows(spark, folder):
    """Four kinds of rules for the suppliers, in three stages."""
    s = F.col("s_suppkey")
    none = lambda kind: F.lit(None).cast(kind)
    years = lambda *values: F.array(*[F.lit(v).cast("string") if isinstance(v, int) else v.cast("string") for v in values])
    bags = lambda *values: F.array(*[F.lit(str(v)) for v in values])
    edit = lambda **values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair]).cast("map<string,string>")

    def rule(stage, rest, action, **given):
        kinds = {"batch": "array<string>", "param": "string", "bag_op": "string", "bags": "array<string>", "on": "array<date>",
                 "after": "date", "campaign_before": "int", "sets": "array<map<string,string>>"}
        return suppliers.filter(s % 4 == rest).select(
            (s + 100_000 * stage).cast("int").alias("seq"), F.lit(stage).alias("stage"), F.lit(action).alias("action"),
            F.array(s.cast("string")).alias("site"), *[given.get(k, none(t)).cast(t).alias(k) for k, t in kinds.items()])

    suppliers = tables.load(spark, folder, "supplier")
    parts = [
        rule(1, 0, "delete", batch=years(1995 + s % 6), bag_op=F.lit(ledger.IN), bags=bags(1, 2)),
        rule(1, 1, "delete", param=F.lit("mass"), after=F.lit("1999-06-01")),
        rule(1, 2, "delete", batch=years(1996, 1997), bag_op=F.lit(ledger.NOT_IN_OR_UNNAMED), bags=bags(1, 2, 3)),
        rule(2, 3, "copy", param=F.lit("dead"), on=F.array(F.lit("1996-03-01"), F.lit("1997-03-01")),
             sets=F.array(edit(id_ind="8", value="0"), edit(id_ind=None, code_param="alive"))),
        rule(2, 0, "replace", batch=years(1998), param=F.lit("alive"), bag_op=F.lit(ledger.IN), bags=bags(3),
             sets=F.array(edit(id_ind="9"))),
        rule(3, 1, "delete", param=F.lit("mass"), campaign_before=F.lit(1997)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""
WITH {base.OBS},
s1 AS (
  SELECT * FROM obs
  WHERE NOT coalesce(site % 4 = 0 AND batch = 1995 + site % 6 AND id_ind IN (1, 2), false)
    AND NOT (site % 4 = 1 AND code_param = 'mass' AND date > DATE '1999-06-01')
    AND NOT (site % 4 = 2 AND batch IN (1996, 1997) AND (id_ind IS NULL OR id_ind NOT IN (1, 2, 3)))),
hit AS (SELECT * FROM s1 WHERE site % 4 = 3 AND code_param = 'dead' AND date IN (DATE '1996-03-01', DATE '1997-03-01')),
s2 AS (
  SELECT * REPLACE (CASE WHEN site % 4 = 0 AND batch = 1998 AND code_param = 'alive' AND id_ind = 3 THEN 9 ELSE id_ind END AS id_ind)
  FROM s1
  UNION ALL SELECT batch, site, campaign, date, 8, code_param, 0 FROM hit
  UNION ALL SELECT batch, site, campaign, date, NULL, 'alive', value FROM hit)
SELECT * REPLACE (round(value, 4) AS value) FROM s2 WHERE NOT (site % 4 = 1 AND code_param = 'mass' AND campaign < 1997)""")
def ledger_from_table(spark, folder):
    """As many rules as the suppliers give, matched by hash."""
    out = rule_tables.apply_table(tables.shipments(spark, folder), _rule_rows(spark, folder), AT)
    return out.withColumn("value", F.round("value", 4))
