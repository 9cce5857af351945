"""SQL texts of the adapted tables."""

LINES = """lines AS (
  SELECT year(l_shipdate)::INT AS batch, l_suppkey AS site, year(l_shipdate)::INT AS campaign,
         date_trunc('month', l_shipdate)::DATE AS date, nullif(l_linenumber, 4) AS id_ind, l_quantity AS quantity,
         l_extendedprice / pi() AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag
  FROM lineitem)"""

VISITS = LINES + """, visits AS (
  SELECT batch, site, campaign, date, id_ind,
         sum(CASE WHEN flag = 'R' THEN quantity END) AS dead,
         sum(CASE WHEN flag <> 'R' THEN quantity END) AS alive, sum(price) AS mass
  FROM lines GROUP BY ALL)"""

COUNTS = VISITS + """, counts AS (
  SELECT * REPLACE (coalesce(dead, 0) AS dead, coalesce(alive, 0) AS alive) FROM visits)"""

OBS = VISITS + """, obs AS (
  SELECT batch, site, campaign, date, id_ind, 'dead' AS code_param, dead AS value FROM visits WHERE dead IS NOT NULL
  UNION ALL
  SELECT batch, site, campaign, date, id_ind, 'alive', alive FROM visits WHERE alive IS NOT NULL
  UNION ALL
  SELECT batch, site, campaign, date, id_ind, 'mass', mass FROM visits)"""

EVENTS = """ev AS (
  SELECT user_id AS unit, ts::DATE AS date, event_type AS code_param, value FROM events)"""

CURVES = """monthly AS (
  SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'N0' ELSE 'J1' END AS class_age,
         c_nationkey AS site, year(o_orderdate)::INT AS campaign, date_trunc('month', o_orderdate)::DATE AS date,
         sum(o_totalprice) AS revenue, count(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
curves AS (
  SELECT class_age, site, campaign, date, date_diff('day', make_date(campaign, 1, 1), date)::INT AS DOY,
         sum(revenue) OVER (PARTITION BY class_age, site, campaign ORDER BY date ROWS UNBOUNDED PRECEDING)
           / sum(revenue) OVER (PARTITION BY class_age, site, campaign) AS share,
         10.0::DOUBLE + 50.0::DOUBLE * (sum(orders) OVER (PARTITION BY class_age, site, campaign ORDER BY date ROWS UNBOUNDED PRECEDING)
           / sum(orders) OVER (PARTITION BY class_age, site, campaign))::DOUBLE AS mass
  FROM monthly)"""

ODD_CURVES = CURVES + """, odd AS (
  SELECT * REPLACE (CASE site % 5 WHEN 1 THEN 0 WHEN 2 THEN 0.9::DOUBLE / (1 + exp(-0.05::DOUBLE * (DOY - middle))) ELSE share END AS share)
  FROM (SELECT *, min(CASE WHEN share >= 0.5 THEN DOY END) OVER (PARTITION BY class_age, site, campaign) AS middle FROM curves))"""

NATIONS = """sites AS (
  SELECT n_nationkey AS site, n_name AS name, r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey)"""

RATES = COUNTS + """, rates AS (
  SELECT batch, site, id_ind, date, mi,
         CASE WHEN mi IS NOT NULL THEN 1 - product(1 - mi) OVER (
           PARTITION BY batch, site, id_ind ORDER BY date ROWS UNBOUNDED PRECEDING) END AS mc
  FROM (SELECT *, dead / nullif(dead + alive, 0) AS mi FROM counts))"""

MEAN_RATES = RATES + """, mean_rates AS (
  SELECT batch, site, date, avg(mc) AS mean_cm FROM rates GROUP BY ALL)"""
