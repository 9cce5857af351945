"""Audits and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import quality
from tidemark.operators.selection import gate_days, gate_measures
from tidemark.plans.queries import base
from tidemark.plans.queries.registry import query
from tidemark.sources import tables

BAG = ["batch", "site", "id_ind"]
VISIT = ["batch", "site", "date"]
AT = tables.AT


def _rates(spark, folder):
    return ind.cumulative_rate(tables.shipment_counts(spark, folder), BAG, "date", "dead", "alive")


def _mean_rates(spark, folder):
    return ind.mean_per_visit(_rates(spark, folder), VISIT, "mc", "mean_cm")


def _bag_mass(spark, folder):
    recent = tables.shipments(spark, folder).filter("batch > 1998")
    return ind.bag_mass(recent, BAG, VISIT, "code_param", "value", "mass", "alive")


def _individual_mass(spark, folder):
    lines = tables.shipment_lines(spark, folder).withColumn("value", F.col("price") / F.col("quantity"))
    return ind.individual_mass(lines, VISIT, "date", "value", F.col("flag") != "R", F.col("batch") > 1998)


def _masses():
    """Bags weigh from 1999 on."""
    return ind.visit_masses("mass", "alive", F.col("batch") > 1998, "singles", "n_singles")


BAG_MASS = base.VISITS + """, bag_masses AS (
  SELECT batch, site, date, avg(mass / nullif(alive, 0)) AS bag_mass FROM visits
  WHERE batch > 1998 AND mass IS NOT NULL AND alive IS NOT NULL GROUP BY ALL)"""

INDIVIDUAL_MASS = """individual_all AS (
  SELECT batch, site, date, avg(price / quantity) AS individual_mass FROM lines WHERE flag <> 'R' GROUP BY ALL),
individual_masses AS (
  SELECT * FROM individual_all QUALIFY NOT (batch > 1998 AND date > min(date) OVER (PARTITION BY batch, site)))"""

SPLICED = BAG_MASS + ", " + INDIVIDUAL_MASS + """, spliced AS (
  SELECT batch, site, date, coalesce(individual_mass, bag_mass) AS mean_mass
  FROM individual_masses FULL JOIN bag_masses USING (batch, site, date))"""


@query(f"""
WITH {base.OBS}, c AS (
  SELECT batch, site, date, nullif(count(CASE WHEN code_param = 'dead' THEN 1 END), 0) AS dead,
         nullif(count(CASE WHEN code_param = 'alive' THEN 1 END), 0) AS alive
  FROM obs WHERE code_param IN ('dead', 'alive') GROUP BY ALL)
SELECT batch, site, date, dead, alive, dead - alive AS difference,
       CASE WHEN dead - alive IS NULL THEN 'missing' WHEN dead < alive THEN 'fewer' WHEN dead > alive THEN 'more'
            ELSE 'equal' END AS status
FROM c WHERE dead IS NULL OR alive IS NULL OR dead <> alive""")
def audit_counts(spark, folder):
    audit = quality.audit_counts(tables.shipments(spark, folder), VISIT, "code_param", "dead", "alive")
    return audit.filter(F.col("status") != "equal")


@query(f"""
WITH {base.VISITS}, m AS (
  SELECT batch, site, id_ind, date, mass / nullif(alive, 0) AS bag_mean,
         row_number() OVER (PARTITION BY batch, site, id_ind ORDER BY date DESC) AS r
  FROM visits),
p AS (
  SELECT l.batch, l.site, l.id_ind, l.date AS last_date, l.bag_mean AS last_mass, s.date AS second_last_date,
         s.bag_mean AS second_last_mass
  FROM (SELECT * FROM m WHERE r = 1) l JOIN (SELECT * FROM m WHERE r = 2) s
    ON l.batch = s.batch AND l.site = s.site AND l.id_ind IS NOT DISTINCT FROM s.id_ind)
SELECT batch, site, id_ind, last_date, round(last_mass, 6) AS last_mass, second_last_date,
       round(second_last_mass, 6) AS second_last_mass,
       round(last_mass * 100 / nullif(second_last_mass, 0), 6) AS change
FROM p WHERE month(last_date) >= 10 AND date_diff('day', second_last_date, last_date) < 40
  AND (last_mass * 100 / second_last_mass > 125 OR last_mass * 100 / second_last_mass < 75)""")
def late_jump_flag(spark, folder):
    out = quality.late_jumps(tables.shipments(spark, folder), BAG, "date", "code_param", "value", "alive", "mass")
    return out.withColumns({c: F.round(c, 6) for c in ("last_mass", "second_last_mass", "change")})


@query(f"""
WITH {base.OBS}
SELECT site, date, campaign,
       count(DISTINCT id_ind) + max(CASE WHEN id_ind IS NULL THEN 1 ELSE 0 END) AS n_bags,
       date_diff('day', make_date(campaign, 1, 1), date)::INT AS offset
FROM obs WHERE code_param = 'dead' GROUP BY site, date, campaign""")
def bag_continuity(spark, folder):
    dead = tables.shipments(spark, folder).filter("code_param = 'dead'")
    return quality.bag_continuity(dead, ["site"], "id_ind", "date", "campaign")


@query(f"""
WITH {base.OBS}
SELECT site, id_ind, campaign, count(*) AS n, min(date) AS first_date FROM obs
WHERE campaign < 1998 AND code_param = 'alive' GROUP BY ALL HAVING count(*) > 2 AND count(*) < 6
UNION ALL
SELECT site, id_ind, campaign, count(*), min(date) FROM obs
WHERE campaign >= 1998 AND code_param = 'alive' GROUP BY ALL HAVING month(min(date)) > 3""")
def visit_screen(spark, folder):
    alive = tables.shipments(spark, folder).filter("code_param = 'alive'")
    keys = ["site", "id_ind", "campaign"]
    early = quality.visit_screen(alive.filter("campaign < 1998"), keys, "date", above=2, below=6)
    late = quality.visit_screen(alive.filter("campaign >= 1998"), keys, "date", first_month_after=3)
    return early.unionByName(late)


@query(f"""
WITH {base.RATES} SELECT batch, site, id_ind, date, round(mi, 6) AS mi, round(mc, 6) AS mc FROM rates""")
def cumulative_rate(spark, folder):
    return _rates(spark, folder).select(*BAG, "date", F.round("mi", 6).alias("mi"), F.round("mc", 6).alias("mc"))


@query(f"""
WITH {base.VISITS} SELECT batch, site, id_ind, date, dead, alive FROM visits WHERE dead IS NOT NULL AND alive IS NOT NULL""")
def both_counts(spark, folder):
    return ind.count_visits(tables.shipments(spark, folder), BAG, "date", "code_param", "value", "dead", "alive")


@query(f"""
WITH {base.MEAN_RATES} SELECT batch, site, date, round(mean_cm, 6) AS mean_cm FROM mean_rates""")
def mean_cumulative_rate(spark, folder):
    return _mean_rates(spark, folder).withColumn("mean_cm", F.round("mean_cm", 6))


@query(f"""
WITH {base.RATES}, followed AS (
  SELECT * FROM rates QUALIFY count(*) OVER (PARTITION BY batch, site, id_ind) >= 4
    AND month(max(date) OVER (PARTITION BY batch, site, id_ind)) >= 10)
SELECT batch, site, date, round(avg(mc), 6) AS mean_cm FROM followed GROUP BY ALL""")
def gated_cumulative_rate(spark, folder):
    followed = gate_days(_rates(spark, folder), BAG, 4, 10)
    return ind.mean_per_visit(followed, VISIT, "mc", "mean_cm").withColumn("mean_cm", F.round("mean_cm", 6))


@query(f"""
WITH {BAG_MASS} SELECT batch, site, date, round(bag_mass, 6) AS bag_mass FROM bag_masses""")
def bag_mass(spark, folder):
    return _bag_mass(spark, folder).withColumn("bag_mass", F.round("bag_mass", 6))


@query(f"""
WITH {base.LINES}, {INDIVIDUAL_MASS}
SELECT batch, site, date, round(individual_mass, 6) AS individual_mass FROM individual_masses""")
def individual_mass(spark, folder):
    return _individual_mass(spark, folder).withColumn("individual_mass", F.round("individual_mass", 6))


@query(f"""
WITH {SPLICED} SELECT batch, site, date, round(mean_mass, 6) AS mean_mass FROM spliced""")
def protocol_splice(spark, folder):
    visits = tables.shipment_measures(spark, folder).groupBy(*VISIT).agg(*_masses())
    spliced = ind.spliced_mass(visits, ["batch", "site"], "date", F.col("batch") > 1998)
    return spliced.filter("has_mass").select(*VISIT, F.round("mean_mass", 6).alias("mean_mass"))


@query(f"""
WITH {base.MEAN_RATES}, {SPLICED.replace(base.VISITS + ', ', '')}, {base.NATIONS},
m AS (SELECT * FROM mean_rates QUALIFY count(*) OVER (PARTITION BY batch, site) >= 4
      AND month(max(date) OVER (PARTITION BY batch, site)) >= 10),
w AS (SELECT * FROM spliced QUALIFY count(*) OVER (PARTITION BY batch, site) >= 4
      AND month(max(date) OVER (PARTITION BY batch, site)) >= 10)
SELECT s_suppkey AS site, name, zone, batch AS campaign, date, date_diff('day', make_date(batch, 1, 1), date)::INT AS DOY,
       round(mean_cm, 6) AS mean_cm, round(mean_mass, 2) AS mean_mass
FROM (SELECT * FROM m FULL JOIN w USING (batch, site, date)) f JOIN supplier ON s_suppkey = f.site JOIN sites n ON n.site = s_nationkey""")
def final_assembly(spark, folder):
    visits = ind.rate_and_mass(tables.shipment_measures(spark, folder), BAG, VISIT, "date", "dead", "alive", _masses(), "mean_cm")
    both = ind.spliced_mass(visits, ["batch", "site"], "date", F.col("batch") > 1998)
    gated = gate_measures(both, ["batch", "site"], {"mean_cm": F.lit(True), "mean_mass": F.col("has_mass")}, 4, 10)
    suppliers = tables.load(spark, folder, "supplier").join(
        tables.nations(spark, folder).withColumnRenamed("site", "s_nationkey"), "s_nationkey").select(
        F.col("s_suppkey").alias("site"), "name", "zone")
    table = ind.describe(gated, suppliers, "site", "date", F.col("batch"), {"campaign": F.col("batch")})
    return table.select("site", "name", "zone", "campaign", "date", "DOY", F.round("mean_cm", 6).alias("mean_cm"),
                        F.round("mean_mass", 2).alias("mean_mass"))


@query(f"""
WITH {base.VISITS}
SELECT batch, site, date, round(avg(mass / nullif(alive, 0)), 6) AS mean_mass, 'bag' AS measure FROM visits
WHERE mass IS NOT NULL AND alive IS NOT NULL GROUP BY batch, site, date
UNION ALL
SELECT batch, site, date, round(avg(price), 6), 'individual' FROM lines GROUP BY batch, site, date""")
def measure_compare(spark, folder):
    masses = ind.visit_masses("mass", "alive", F.lit(True), "mass", "lines")
    visits = tables.shipment_measures(spark, folder).groupBy(*VISIT).agg(*masses)
    out = quality.stack_measures(visits, VISIT, {
        "bag": (F.col("bag_mass"), F.col("n_weighed") > 0), "individual": (F.col("individual_mass"), F.lit(True))})
    return out.withColumn("mean_mass", F.round("mean_mass", 6))
