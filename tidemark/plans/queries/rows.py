"""Row-wise work: parsing, recoding, filters, row generation and joins."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import derive
from tidemark.functions.nulls import composite_key
from tidemark.operators import joins, quality, rows
from tidemark.plans.queries import base
from tidemark.plans.queries.registry import query
from tidemark.session import shared_folder
from tidemark.sources import sinks, tables
from tidemark.sources.observations import in_box


@query("""
SELECT event_id AS id, user_id AS unit, event_type AS parameter, value, value * 2 AS doubled, 'unit' AS measure
FROM events""")
def project_rename(spark, folder):
    df = tables.load(spark, folder, "events").toDF("id", "ts", "unit", "parameter", "value", "props")
    df = df.withColumnRenamed("unit", "who").withColumnRenamed("who", "unit")
    return df.drop("ts", "props").withColumn("doubled", F.col("value") * 2).withColumn("measure", F.lit("unit"))


@query("""
SELECT event_id, strftime(ts, '%d/%m/%Y') AS day_text, ts::DATE AS day,
       try_cast(CASE WHEN event_type = 'error' THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS number,
       try_cast(NULL AS DATE) AS bad_day
FROM events""")
def typed_parse(spark, folder):
    df = tables.load(spark, folder, "events")
    text = F.date_format("ts", "dd/MM/yyyy")
    number = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return df.select(
        "event_id", text.alias("day_text"), derive.parse_date(text).alias("day"),
        derive.parse_number(number).alias("number"),
        derive.parse_date(F.concat(F.lit("31/02/"), F.date_format("ts", "yyyy"))).alias("bad_day"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_discount * l_tax * 10, 3) AS rate, round(l_extendedprice / pi(), 2) AS price
FROM lineitem""")
def publish_rounding(spark, folder):
    df = tables.load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * F.col("l_tax") * 10).alias("rate"),
        (F.col("l_extendedprice") / F.pi()).alias("price"))
    return sinks.fixed_digits(df, {"rate": 3, "price": 2})


@query("""
SELECT c_custkey, c_name, nullif(c_nationkey, 7) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def csv_roundtrip(spark, folder):
    df = tables.load(spark, folder, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(7)))
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    sinks.write_csv(df, path)
    return sinks.read_back(df, path)


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, true AS in_order FROM lineitem""")
def csv_sorted(spark, folder):
    """Published in the order of its keys, as the files show."""
    df = tables.load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    sinks.write_csv(df, path, order=["l_orderkey", "l_linenumber"])
    return sinks.in_published_order(df, path, ["l_orderkey", "l_linenumber"])


@query("""
SELECT p_partkey,
  CASE WHEN p_size >= 45 THEN 'ME' WHEN p_type = 'PROMO' THEN 'E2' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'E1'
       WHEN substring(p_name, 1, 3) = 'red' THEN 'MO' WHEN p_type <> 'SMALL' THEN 'AR' END AS code
FROM part""")
def recode_priority(spark, folder):
    brand, kind, name, size = (F.col(c) for c in ("p_brand", "p_type", "p_name", "p_size"))
    code = derive.last_match(
        F.when(kind != "SMALL", "AR"), (derive.span(name, 1, 3) == "red", "MO"),
        (brand.isin("Brand#1", "Brand#2"), "E1"), (kind == "PROMO", "E2"), (size >= 45, "ME"))
    return tables.load(spark, folder, "part").select("p_partkey", code.alias("code"))


@query("""
WITH lookup(p_type, short) AS (VALUES ('ECONOMY', 'EC'), ('STANDARD', 'ST'), ('PROMO', 'PR'), ('MEDIUM', 'ME'))
SELECT p_partkey, p_type, short FROM part LEFT JOIN lookup USING (p_type)""")
def recode_lookup(spark, folder):
    codes = {"ECONOMY": "EC", "STANDARD": "ST", "PROMO": "PR", "MEDIUM": "ME"}
    lookup = joins.small_table(spark, [{"p_type": k, "short": v} for k, v in codes.items()],
                               pa.schema([("p_type", pa.string()), ("short", pa.string())]))
    part = tables.load(spark, folder, "part").select("p_partkey", "p_type")
    return joins.join_keys(part, lookup, ["p_type"], "left").select("p_partkey", "p_type", "short")


@query("""
SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO', 'MEDIUM') GROUP BY p_type""")
def recode_unmatched(spark, folder):
    kinds = ("ECONOMY", "STANDARD", "PROMO", "MEDIUM")
    lookup = joins.small_table(spark, [{"p_type": k} for k in kinds], pa.schema([("p_type", pa.string())]))
    return quality.unmatched_codes(tables.load(spark, folder, "part"), lookup, "p_type")


@query(f"""
WITH {base.LINES}
SELECT concat_ws('_', batch::VARCHAR, flag, coalesce(id_ind::VARCHAR, 'NA'), site::VARCHAR) AS batch_key, count(*) AS n
FROM lines GROUP BY 1""")
def batch_key(spark, folder):
    key = composite_key("batch", "flag", "id_ind", "site").alias("batch_key")
    return tables.shipment_lines(spark, folder).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {base.LINES}
SELECT site, coalesce(id_ind::VARCHAR, 'unidentified') AS bag, count(*) AS n, sum(quantity) AS quantity
FROM lines GROUP BY ALL""")
def bag_fill(spark, folder):
    bag = F.coalesce(F.col("id_ind").cast("string"), F.lit("unidentified")).alias("bag")
    return tables.shipment_lines(spark, folder).groupBy("site", bag).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query(f"""
WITH {base.VISITS}
SELECT batch, site, id_ind, date, coalesce(dead, alive) AS measure,
       CASE WHEN dead > 40 THEN 40.0 ELSE dead END AS capped
FROM visits""")
def measure_coalesce(spark, folder):
    dead = F.col("dead")
    return tables.shipment_visits(spark, folder).select(
        "batch", "site", "id_ind", "date", F.coalesce("dead", "alive").alias("measure"),
        derive.replace_where(dead, dead > 40, F.lit(40.0)).alias("capped"))


@query("""
SELECT p_partkey, p_type, p_size FROM part
WHERE p_type IN ('ECONOMY', 'PROMO') AND NOT (p_size < 10 OR p_size >= 40) AND p_retailprice <> 905.0 AND p_brand IS NOT NULL""")
def filter_members(spark, folder):
    size = F.col("p_size")
    return tables.load(spark, folder, "part").filter(
        F.col("p_type").isin("ECONOMY", "PROMO") & ~((size < 10) | (size >= 40)) & (F.col("p_retailprice") != 905.0)
        & F.col("p_brand").isNotNull()).select("p_partkey", "p_type", "p_size")


@query("""
SELECT p_partkey, p_name, substring(p_brand, 7, 2) AS number FROM part
WHERE p_name LIKE '%ring%' AND substring(p_brand, 1, 5) = 'Brand'""")
def filter_pattern(spark, folder):
    return tables.load(spark, folder, "part").filter(
        F.col("p_name").contains("ring") & (derive.span(F.col("p_brand"), 1, 5) == "Brand")
    ).select("p_partkey", "p_name", derive.span(F.col("p_brand"), 7, 8).alias("number"))


@query(f"""
WITH {base.VISITS}
SELECT batch, site, id_ind, date, dead FROM visits WHERE id_ind IS NOT NULL AND dead IS NOT NULL""")
def dropna_after_project(spark, folder):
    return tables.shipment_visits(spark, folder).select("batch", "site", "id_ind", "date", "dead", "alive").drop(
        "alive").dropna("any")


@query("""
SELECT o_orderkey, date_diff('day', make_date(1997, 1, 1), o_orderdate::DATE)::INT AS day_offset FROM orders
WHERE date_diff('day', make_date(1997, 1, 1), o_orderdate::DATE) <= 365
  AND (o_orderdate::DATE > DATE '1995-06-30' OR o_orderdate::DATE IN (DATE '1995-01-05', DATE '1995-03-10'))""")
def campaign_window(spark, folder):
    day = F.col("o_orderdate").cast("date")
    offset = derive.day_offset(day, F.lit(1997))
    listed = day.isin(*[F.lit(d).cast("date") for d in ("1995-01-05", "1995-03-10")])
    return tables.load(spark, folder, "orders").filter(
        (offset <= 365) & ((day > F.lit("1995-06-30").cast("date")) | listed)
    ).select("o_orderkey", offset.alias("day_offset"))


@query("""
SELECT c_custkey, c_acctbal, c_nationkey FROM customer
WHERE c_acctbal BETWEEN -500.0 AND 2500.5 AND c_nationkey BETWEEN 4 AND 17""")
def bbox(spark, folder):
    points = tables.load(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return in_box(points, "c_acctbal", "c_nationkey", (-500.0, 2500.5), (4, 17))


@query(f"""
WITH {base.OBS}
SELECT batch, site, campaign, date, id_ind, code_param, round(value, 4) AS value, NULL::VARCHAR AS note FROM obs
UNION ALL
SELECT batch, site, campaign, date, NULL, 'deaths', sum(value), 'all bags' FROM obs WHERE code_param = 'dead'
GROUP BY batch, site, campaign, date""")
def append_fill(spark, folder):
    obs = tables.shipments(spark, folder)
    whole = obs.filter(F.col("code_param") == "dead").groupBy("batch", "site", "campaign", "date").agg(
        F.sum("value").alias("value")).withColumns({"code_param": F.lit("deaths"), "note": F.lit("all bags")})
    out = rows.append(obs.withColumn("note", F.lit(None).cast("string")), whole, fill=True)
    return out.withColumn("value", F.round("value", 4))


@query(f"""
WITH {base.VISITS}, few AS (SELECT * FROM visits)
SELECT batch, site, date, g AS id_ind, round(mass, 4) AS mass, i::INT AS copy
FROM (SELECT batch, site, date, mass, id_ind, unnest([2, 3]) AS g, unnest([1, 2]) AS i FROM few)
WHERE id_ind IS NULL
UNION ALL
SELECT batch, site, date, id_ind, round(mass, 4), 0 FROM few WHERE id_ind IS NOT NULL""")
def replicate_rows(spark, folder):
    few = tables.shipment_visits(spark, folder).select("batch", "site", "date", "id_ind", "mass")
    unnamed = rows.repeat_as(few.filter("id_ind IS NULL"), "id_ind", [2, 3])
    out = rows.append(unnamed.withColumn("copy", F.col("id_ind") - 1),
                      few.filter("id_ind IS NOT NULL").withColumn("copy", F.lit(0)))
    return out.withColumn("mass", F.round("mass", 4))


@query(f"""
WITH {base.OBS}
SELECT batch, site, campaign, date, id_ind, code_param, round(value, 4) AS value FROM obs
UNION ALL
SELECT batch, site, campaign, DATE '1996-01-01', id_ind, code_param, 50.0 FROM obs
WHERE batch = 1996 AND code_param = 'alive' AND date = DATE '1996-03-01'
UNION ALL
SELECT batch, site, campaign, date, id_ind, 'dead', 0.0 FROM obs
WHERE code_param = 'alive' AND value > 45 AND id_ind <> 1""")
def copy_edit_insert(spark, folder):
    param, value = F.col("code_param"), F.col("value")
    march = (F.col("batch") == 1996) & (param == "alive") & (F.col("date") == F.lit("1996-03-01").cast("date"))
    full = (param == "alive") & (value > 45) & (F.col("id_ind") != 1)
    return rows.copy_edit(tables.shipments(spark, folder), [
        (march, {"date": F.lit("1996-01-01"), "value": F.lit(50.0)}),
        (full, {"code_param": F.lit("dead"), "value": F.lit(0.0)}),
    ]).withColumn("value", F.round("value", 4))


@query(f"""
WITH {base.LINES}, marked AS (SELECT DISTINCT batch, site, id_ind, date FROM lines WHERE flag = 'R' AND quantity > 40)
SELECT batch, site, id_ind, date, quantity, flag FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.batch = l.batch AND m.site = l.site
                  AND m.id_ind IS NOT DISTINCT FROM l.id_ind AND m.date = l.date)""")
def anti_all_columns(spark, folder):
    lines = tables.shipment_lines(spark, folder).select("batch", "site", "id_ind", "date", "quantity", "flag")
    marked = lines.filter("flag = 'R' AND quantity > 40").select("batch", "site", "id_ind", "date")
    return joins.anti_identical(lines, marked)


@query(f"""
WITH {base.LINES}, late AS (
  SELECT batch, site, flag, max(quantity) AS quantity FROM lines GROUP BY ALL HAVING count(*) > 4)
SELECT batch, site, id_ind, date, flag, quantity FROM lines l
WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT batch, site, CASE WHEN flag = 'N' THEN NULL ELSE flag END AS flag, quantity FROM late) r
  WHERE r.batch = l.batch AND r.site = l.site AND (r.flag IS NULL OR r.flag = l.flag) AND r.quantity = l.quantity)""")
def anti_rule_table(spark, folder):
    lines = tables.shipment_lines(spark, folder).select("batch", "site", "id_ind", "date", "flag", "quantity")
    rules = lines.groupBy("batch", "site", "flag").agg(
        F.max("quantity").alias("quantity"), F.count(F.lit(1)).alias("n")).filter("n > 4").withColumn(
        "flag", F.nullif("flag", F.lit("N")))
    return joins.anti_rules(lines, rules, ["batch", "site", "quantity"], ["flag"])


@query(f"""
WITH {base.VISITS}, firsts AS (SELECT batch, site, id_ind, min(date) AS first_date FROM visits GROUP BY ALL)
SELECT v.batch, v.site, v.id_ind, v.date, first_date FROM visits v JOIN firsts f
ON v.batch = f.batch AND v.site = f.site AND v.id_ind IS NOT DISTINCT FROM f.id_ind""")
def inner_nullsafe(spark, folder):
    visits = tables.shipment_visits(spark, folder)
    bag = ["batch", "site", "id_ind"]
    firsts = visits.groupBy(*bag).agg(F.min("date").alias("first_date"))
    return joins.join_keys(visits.select(*bag, "date"), firsts, bag)


@query(f"""
WITH {base.NATIONS}
SELECT c_custkey, c_nationkey AS site, name, zone FROM customer JOIN sites ON c_nationkey = site""")
def dim_inner(spark, folder):
    customers = tables.load(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("site"))
    return joins.join_keys(customers, tables.nations(spark, folder), ["site"])


@query(f"""
WITH {base.NATIONS}
SELECT s_suppkey, s.site, name, zone FROM (SELECT s_suppkey, nullif(s_nationkey, 3) AS site FROM supplier) s
LEFT JOIN (SELECT nullif(site, 8) AS site, name, zone FROM sites) d ON s.site IS NOT DISTINCT FROM d.site""")
def dim_left(spark, folder):
    suppliers = tables.load(spark, folder, "supplier").select(
        "s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("site"))
    dims = tables.nations(spark, folder).withColumn("site", F.nullif("site", F.lit(8)))
    return joins.join_keys(suppliers, dims, ["site"], "left")


@query(f"""
WITH {base.VISITS},
d AS (SELECT batch, site, date, sum(dead) AS dead FROM visits WHERE dead IS NOT NULL GROUP BY ALL),
a AS (SELECT batch, site, date, sum(alive) AS alive FROM visits WHERE alive IS NOT NULL GROUP BY ALL)
SELECT batch, site, date, dead, alive FROM d FULL JOIN a USING (batch, site, date)""")
def full_outer_3key(spark, folder):
    visits = tables.shipment_visits(spark, folder)
    key = ["batch", "site", "date"]
    d = visits.filter("dead IS NOT NULL").groupBy(*key).agg(F.sum("dead").alias("dead"))
    a = visits.filter("alive IS NOT NULL").groupBy(*key).agg(F.sum("alive").alias("alive"))
    return joins.join_keys(d, a, key, "full")


@query(f"""
WITH {base.LINES},
r AS (SELECT batch, site, nullif(id_ind, 1) AS id_ind, date, flag, sum(quantity) AS quantity FROM lines GROUP BY ALL),
p AS (SELECT batch, site, nullif(id_ind, 2) AS id_ind, date, flag, sum(price) AS price FROM lines GROUP BY ALL)
SELECT coalesce(r.batch, p.batch) AS batch, coalesce(r.site, p.site) AS site, coalesce(r.id_ind, p.id_ind) AS id_ind,
       coalesce(r.date, p.date) AS date, coalesce(r.flag, p.flag) AS flag, quantity, round(price, 2) AS price
FROM r FULL JOIN p ON r.batch IS NOT DISTINCT FROM p.batch AND r.site IS NOT DISTINCT FROM p.site
 AND r.id_ind IS NOT DISTINCT FROM p.id_ind AND r.date IS NOT DISTINCT FROM p.date AND r.flag IS NOT DISTINCT FROM p.flag""")
def full_outer_multi(spark, folder):
    lines = tables.shipment_lines(spark, folder)
    key = ["batch", "site", "id_ind", "date", "flag"]
    r = lines.withColumn("id_ind", F.nullif("id_ind", F.lit(1))).groupBy(*key).agg(F.sum("quantity").alias("quantity"))
    p = lines.withColumn("id_ind", F.nullif("id_ind", F.lit(2))).groupBy(*key).agg(F.round(F.sum("price"), 2).alias("price"))
    return joins.join_keys(r, p, key, "full")


@query(f"""
WITH {base.VISITS}, rich AS (SELECT batch, site FROM visits GROUP BY ALL HAVING sum(mass) > 1270000)
SELECT batch, site, id_ind, date FROM visits v
WHERE EXISTS (SELECT 1 FROM rich r WHERE r.batch = v.batch AND r.site = v.site)""")
def semi_keys(spark, folder):
    visits = tables.shipment_visits(spark, folder)
    rich = visits.groupBy("batch", "site").agg(F.sum("mass").alias("m")).filter("m > 1270000")
    return joins.join_keys(visits.select("batch", "site", "id_ind", "date"), rich, ["batch", "site"], "left_semi")


@query(f"""
WITH {base.LINES}, marked AS (SELECT DISTINCT batch, site, id_ind FROM lines WHERE quantity = 50)
SELECT l.batch, l.site, l.id_ind, l.date, l.quantity, CASE WHEN m.batch IS NULL THEN 'no' ELSE 'yes' END AS issue
FROM lines l LEFT JOIN marked m ON l.batch = m.batch AND l.site = m.site AND l.id_ind IS NOT DISTINCT FROM m.id_ind""")
def flag_left(spark, folder):
    lines = tables.shipment_lines(spark, folder).select("batch", "site", "id_ind", "date", "quantity")
    return joins.flag_matches(lines, lines.filter("quantity = 50"), ["batch", "site", "id_ind"], "issue")
