"""Group summaries, reshaping and group selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.nulls import distinct_count_with_null
from tidemark.operators import aggregates, reshape, selection
from tidemark.plans.queries import base
from tidemark.plans.queries.registry import query
from tidemark.sources import tables

BAG = ["batch", "site", "id_ind"]


@query(f"""
WITH {base.OBS}
SELECT batch, site, code_param, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean,
       min(date) AS first_date, max(date) AS last_date, round(min(value), 4) AS least, round(max(value), 4) AS most
FROM obs GROUP BY ALL""")
def group_stats(spark, folder):
    return tables.shipments(spark, folder).groupBy("batch", "site", "code_param").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.min("value"), 4).alias("least"),
        F.round(F.max("value"), 4).alias("most"))


@query("""
SELECT ts::DATE AS date, event_type AS code_param, round(median(value), 6) AS middle, count(value) AS n FROM events GROUP BY ALL""")
def group_median(spark, folder):
    out = aggregates.exact_median(tables.events(spark, folder), ["date", "code_param"], "value", "middle", count="n")
    return out.withColumn("middle", F.round("middle", 6))


@query("""
SELECT l_returnflag AS flag, round(median(l_extendedprice), 6) AS middle FROM lineitem GROUP BY ALL""")
def hot_group_median(spark, folder):
    lines = tables.load(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    out = aggregates.exact_median(lines, ["flag"], "l_extendedprice", "middle")
    return out.withColumn("middle", F.round("middle", 6))


@query(f"""
WITH {base.LINES}
SELECT batch, site, date, count(DISTINCT id_ind) + max(CASE WHEN id_ind IS NULL THEN 1 ELSE 0 END) AS n_bags
FROM lines GROUP BY ALL""")
def distinct_with_null(spark, folder):
    return tables.shipment_lines(spark, folder).groupBy("batch", "site", "date").agg(
        distinct_count_with_null("id_ind").alias("n_bags"))


@query("""
SELECT DISTINCT user_id AS unit, ts::DATE AS date, event_type AS code_param FROM events""")
def distinct_rows(spark, folder):
    return tables.events(spark, folder).drop("value").dropDuplicates()


@query(f"""
WITH {base.LINES}
SELECT batch, site, date, round(avg(m), 6) AS mean_ratio FROM (
  SELECT batch, site, date, id_ind, avg(price / quantity) AS m FROM lines GROUP BY ALL) GROUP BY ALL""")
def mean_of_means(spark, folder):
    out = aggregates.mean_of_means(tables.shipment_lines(spark, folder), [*BAG, "date"], ["batch", "site", "date"],
                                   F.col("price") / F.col("quantity"), "mean_ratio")
    return out.withColumn("mean_ratio", F.round("mean_ratio", 6))


@query(f"""
WITH {base.VISITS}
SELECT batch, site, count(*) AS n, CASE WHEN count(dead) = count(*) THEN round(avg(dead), 6) END AS strict_mean,
       round(avg(dead), 6) AS known_mean
FROM visits GROUP BY ALL""")
def strict_mean(spark, folder):
    from tidemark.functions.nulls import mean
    dead = F.col("dead")
    return tables.shipment_visits(spark, folder).groupBy("batch", "site").agg(
        F.count(F.lit(1)).alias("n"), F.round(mean(dead, strict=True), 6).alias("strict_mean"),
        F.round(mean(dead), 6).alias("known_mean"))


@query("""
WITH t AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderstatus, o_orderpriority, n, round_even(100.0::DOUBLE * n / (SELECT sum(n) FROM t), 0) AS percent FROM t""")
def percent_total(spark, folder):
    return aggregates.percent_share(tables.load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS date FROM events),
b AS (SELECT user_id, min(date) AS f, max(date) AS l FROM d GROUP BY ALL)
SELECT 'first' AS bound, median(date_diff('day', DATE '2024-01-01', f)) AS middle FROM b
UNION ALL SELECT 'last', median(date_diff('day', DATE '2024-01-01', l)) FROM b""")
def endpoint_median(spark, folder):
    days = tables.events(spark, folder).select(
        "unit", F.datediff("date", F.lit("2024-01-01").cast("date")).alias("day")).distinct()
    first = aggregates.endpoint_median(days, ["unit"], "day", name="middle")
    last = aggregates.endpoint_median(days, ["unit"], "day", last=True, name="middle")
    return first.select(F.lit("first").alias("bound"), "middle").unionByName(
        last.select(F.lit("last").alias("bound"), "middle"))


@query(f"""
WITH {base.VISITS},
e AS (SELECT batch, site, min(date) AS f, max(date) AS l FROM visits GROUP BY ALL)
SELECT round(max(CASE WHEN date = l THEN mass END), 4) AS last_bound, round(max(CASE WHEN date = f THEN mass END), 4) AS first_bound
FROM visits JOIN e USING (batch, site)""")
def endpoint_bounds(spark, folder):
    visits = tables.shipment_visits(spark, folder)
    last = aggregates.endpoint_max(visits, ["batch", "site"], "date", "mass", name="last_bound")
    first = aggregates.endpoint_max(visits, ["batch", "site"], "date", "mass", last=False, name="first_bound")
    return last.select(F.round("last_bound", 4).alias("last_bound"), F.round(first.scalar(), 4).alias("first_bound"))


@query(f"""
WITH {base.OBS}
SELECT batch, site, id_ind, date, max(CASE WHEN code_param = 'dead' THEN value END) AS dead,
       max(CASE WHEN code_param = 'alive' THEN value END) AS alive, round(max(CASE WHEN code_param = 'mass' THEN value END), 4) AS mass
FROM obs GROUP BY ALL""")
def pivot_values(spark, folder):
    return reshape.pivot_values(tables.shipments(spark, folder), [*BAG, "date"], "code_param", "value",
                                ["dead", "alive", "mass"]).withColumn("mass", F.round("mass", 4))


@query(f"""
WITH {base.EVENTS}
SELECT unit, date, """ + ", ".join(
    f"nullif(count(CASE WHEN code_param = '{e}' THEN 1 END), 0) AS {e}" for e in tables.EVENT_TYPES) + f""",
       nullif(count(CASE WHEN code_param IS NULL OR code_param NOT IN ({", ".join(f"'{e}'" for e in tables.EVENT_TYPES)}) THEN 1 END), 0)
         AS other
FROM ev GROUP BY ALL""")
def pivot_counts(spark, folder):
    return reshape.pivot_counts(tables.events(spark, folder), ["unit", "date"], "code_param", tables.EVENT_TYPES, "other")


@query(f"""
WITH {base.EVENTS} SELECT unit, date, code_param, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1""")
def pivot_guard(spark, folder):
    return reshape.crowded_cells(tables.events(spark, folder), ["unit", "date"], "code_param")


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, date, 'quantity' AS variable, quantity AS measure FROM lines
UNION ALL SELECT batch, site, id_ind, date, 'price', round(price, 4) FROM lines""")
def unpivot_measures(spark, folder):
    return reshape.unpivot_measures(tables.shipment_lines(spark, folder), [*BAG, "date"], ["quantity", "price"],
                                    "variable", "measure").withColumn("measure", F.round("measure", 4))


@query(f"""
WITH {base.EVENTS}
SELECT unit, code_param, date, value FROM ev""")
def nest_unnest(spark, folder):
    """All rows come back, repeats too."""
    nested = reshape.nest_days(tables.events(spark, folder), ["unit", "code_param"], "date", ["value"])
    return reshape.unnest_days(nested, ["unit", "code_param"])


@query(f"""
WITH {base.LINES}
SELECT batch, site, date, id_ind, 'quantity' AS param, count(*) AS n, min(quantity) AS least, max(quantity) AS most FROM lines
GROUP BY ALL HAVING count(*) > 1""")
def pivot_quarantine(spark, folder):
    """Crowded cells, set aside by the aggregate that pivots."""
    long = tables.shipment_lines(spark, folder).unpivot([*BAG, "date"], ["quantity"], "param", "value")
    wide = reshape.pivot_cells(long, [*BAG, "date"], "param", "value", ["quantity"])
    return reshape.set_aside(wide, [*BAG, "date"])


@query(f"""
WITH {base.LINES}, b AS (SELECT batch, site, min(date) AS first_date, max(date) AS last_date FROM lines GROUP BY ALL)
SELECT l.batch, l.site, l.id_ind, l.date, l.quantity, first_date, last_date FROM lines l JOIN b USING (batch, site)""")
def group_min_attach(spark, folder):
    lines = tables.shipment_lines(spark, folder).select(*BAG, "date", "quantity")
    return selection.attach_bounds(lines, ["batch", "site"], "date", "first_date", "last_date")


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, date, quantity, round(price, 4) AS price FROM lines
QUALIFY rank() OVER (PARTITION BY batch, site, id_ind ORDER BY date) = 1""")
def first_visit_rows(spark, folder):
    lines = tables.shipment_lines(spark, folder).select(*BAG, "date", "quantity", "price")
    return selection.rows_at_bound(lines, BAG, "date").withColumn("price", F.round("price", 4))


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, date, quantity FROM lines
QUALIFY dense_rank() OVER (PARTITION BY batch, site, id_ind ORDER BY date DESC) = 2""")
def second_last_visit(spark, folder):
    lines = tables.shipment_lines(spark, folder).select(*BAG, "date", "quantity")
    return selection.rows_at_nth_latest(lines, BAG, "date", 2)


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, date, quantity FROM lines QUALIFY count(*) OVER (PARTITION BY batch, site, id_ind) >= 12""")
def min_visits_gate(spark, folder):
    lines = tables.shipment_lines(spark, folder).select(*BAG, "date", "quantity")
    return selection.gate_rows(lines, BAG, min_rows=12)


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, date, quantity FROM lines
QUALIFY month(max(date) OVER (PARTITION BY batch, site, id_ind)) >= 10""")
def season_end_gate(spark, folder):
    lines = tables.shipment_lines(spark, folder).select(*BAG, "date", "quantity")
    return selection.gate_rows(lines, BAG, end_month=10)


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, date, quantity FROM lines
QUALIFY NOT (batch > 1998 AND date > min(date) OVER (PARTITION BY batch, site))""")
def seed_only_after(spark, folder):
    lines = tables.shipment_lines(spark, folder).select(*BAG, "date", "quantity")
    return selection.first_day_only_where(lines, ["batch", "site"], "date", F.col("batch") > 1998)


@query(f"""
WITH {base.LINES}
SELECT batch, site, id_ind, arg_min(quantity, (date, quantity)) AS first_quantity FROM lines GROUP BY ALL""")
def first_value(spark, folder):
    return selection.first_value(tables.shipment_lines(spark, folder), BAG, "date", "quantity", "first_quantity")
