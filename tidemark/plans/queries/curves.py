"""Fitted curves, their comparison and their predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.curves import GOMPERTZ, LOGISTIC
from tidemark.functions.nulls import ratio
from tidemark.operators import models, predict
from tidemark.operators.fit import Box, Spec, fit_curves, fit_lattice, fit_series
from tidemark.operators.joins import join_keys
from tidemark.operators.selection import best_rows
from tidemark.plans.queries import base
from tidemark.plans.queries.fit_sql import KEYS, curve_value, fits_sql, lattice_sql
from tidemark.plans.queries.registry import query
from tidemark.session import cut_lineage, shared
from tidemark.sources import tables

GROUP = ["class_age", "site", "campaign"]
# The parameter boxes of cumulative mortality and of the mass above a starting mass.
SHARE_BOX = Box(a=(0, 1), b=(0, 0.2), c=(0, 365))
MASS_BOX = Box(a=(0, 86), b=(0, 0.2), c=(0, 365), d=(0, 69))
# shares are small, so their residual sums are told apart further down
SHARE_TIES = 12

#: Slopes and midpoints of the lattice fits.
LATTICE = (51, 37)

SHARE_FITS = base.CURVES + ", " + fits_sql("curves", "DOY", "share", SHARE_BOX, tie_digits=SHARE_TIES)
MASS_FITS = base.CURVES + ", " + fits_sql("curves", "DOY", "mass", MASS_BOX)
ODD_FITS = base.ODD_CURVES + ", " + fits_sql("odd", "DOY", "share", SHARE_BOX, tie_digits=SHARE_TIES)
SHARE_LATTICE = base.CURVES + ", " + lattice_sql("curves", "DOY", "share", SHARE_BOX, *LATTICE, tie_digits=SHARE_TIES)
MASS_LATTICE = base.CURVES + ", " + lattice_sql("curves", "DOY", "mass", MASS_BOX, *LATTICE)
_ON_LATTICE = """class_age, site, campaign, model, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d,
       round(rss, 6) AS rss"""
_ROUNDED = """class_age, site, campaign, model, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, n, k,
       round(rss, 6) AS rss, round(aic, 4) AS aic"""


def _one_search(fits):
    """All readers in the plan share the shuffle behind the search. Medians read their input in subqueries, too, which
    do not share it, so they get a checkpoint.
    """
    return shared(fits, GROUP)


def _share_fits(spark, folder, chosen=(LOGISTIC, GOMPERTZ), cut=None):
    """``cut`` where a query reads the fits more than once, so that the search runs once."""
    fits = fit_curves(tables.order_curves(spark, folder), GROUP, "DOY", "share", SHARE_BOX, models=chosen, tie_digits=SHARE_TIES)
    return cut(fits) if cut else fits


def _mass_fits(spark, folder, chosen=(LOGISTIC, GOMPERTZ), cut=None):
    fits = fit_curves(tables.order_curves(spark, folder), GROUP, "DOY", "mass", MASS_BOX, models=chosen)
    return cut(fits) if cut else fits


def _paired_fits(spark, folder):
    """The chosen curve of both measures of each group: one read of the orders, one search."""
    curves = tables.order_curves(spark, folder).select(*GROUP, "DOY", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("y")) for m in ("share", "mass")])))
    specs = {"share": Spec(SHARE_BOX, (GOMPERTZ,), SHARE_TIES), "mass": Spec(MASS_BOX, (LOGISTIC,))}
    fits = fit_series(curves, GROUP, "measure", "DOY", "y", specs)
    return predict.side_by_side(fits, GROUP, "measure", ["share", "mass"])


def _rounded(fits):
    digits = {"a": 6, "b": 6, "c": 6, "d": 6, "rss": 6, "aic": 4}
    return fits.withColumns({c: F.round(c, n) for c, n in digits.items()}).drop("converged")


@query(f"WITH {SHARE_FITS} SELECT {_ROUNDED} FROM fits WHERE model = 'Logistic'")
def fit_logistic3(spark, folder):
    return _rounded(_share_fits(spark, folder, (LOGISTIC,)))


@query(f"WITH {SHARE_FITS} SELECT {_ROUNDED} FROM fits WHERE model = 'Gompertz'")
def fit_gompertz3(spark, folder):
    return _rounded(_share_fits(spark, folder, (GOMPERTZ,)))


@query(f"WITH {MASS_FITS} SELECT {_ROUNDED} FROM fits WHERE model = 'Logistic'")
def fit_logistic4(spark, folder):
    return _rounded(_mass_fits(spark, folder, (LOGISTIC,)))


@query(f"WITH {MASS_FITS} SELECT {_ROUNDED} FROM fits WHERE model = 'Gompertz'")
def fit_gompertz4(spark, folder):
    return _rounded(_mass_fits(spark, folder, (GOMPERTZ,)))


@query(f"""
WITH {SHARE_FITS}
SELECT class_age, model, count(*) AS n, count(CASE WHEN NOT converged THEN 1 END) AS unsettled,
       count(CASE WHEN aic IS NULL THEN 1 END) AS no_aic, round(max(rss), 6) AS worst_rss, 0 AS with_gap
FROM fits GROUP BY ALL""")
def fit_quality(spark, folder):
    """SQL knows no bounds: it states that every fit is proven."""
    fits = fit_curves(tables.order_curves(spark, folder), GROUP, "DOY", "share", SHARE_BOX, tie_digits=SHARE_TIES, prove=True)
    return fits.groupBy("class_age", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("converged")).alias("unsettled"),
        F.count_if(F.col("aic").isNull()).alias("no_aic"), F.round(F.max("rss"), 6).alias("worst_rss"),
        F.count_if(F.col("gap") > 0).alias("with_gap"))


def _on_lattice(spark, folder, value, box, ties):
    fits = fit_lattice(tables.order_curves(spark, folder), GROUP, "DOY", value, box, *LATTICE, tie_digits=ties)
    return fits.select(*GROUP, "model", *[F.round(c, 6).alias(c) for c in ("a", "b", "c", "d", "rss")])


@query(f"WITH {SHARE_LATTICE} SELECT {_ON_LATTICE} FROM lattice")
def fit_lattice3(spark, folder):
    """Branch and bound against all points."""
    return _on_lattice(spark, folder, "share", SHARE_BOX, SHARE_TIES)


@query(f"WITH {MASS_LATTICE} SELECT {_ON_LATTICE} FROM lattice")
def fit_lattice4(spark, folder):
    return _on_lattice(spark, folder, "mass", MASS_BOX, 9)


@query(f"""
WITH {MASS_LATTICE}
SELECT class_age, model, count(*) AS n, 0 AS with_gap, 0 AS above_lattice FROM lattice GROUP BY ALL""")
def fit_gaps(spark, folder):
    """Proven fits of four parameters: none has a gap, and none lies above the best lattice point."""
    observed = tables.order_curves(spark, folder)
    fits = fit_curves(observed, GROUP, "DOY", "mass", MASS_BOX, prove=True).select(*GROUP, "model", "rss", "gap")
    points = fit_lattice(observed, GROUP, "DOY", "mass", MASS_BOX, *LATTICE).select(*GROUP, "model", F.col("rss").alias("point"))
    both = join_keys(fits, points, [*GROUP, "model"])
    above = F.col("rss") > F.col("point") * (1 + 1e-3) + 1e-6  # the tolerance of the proof
    return both.groupBy("class_age", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 0).alias("with_gap"), F.count_if(above).alias("above_lattice"))


@query(f"""
WITH {SHARE_FITS}, best AS (
  SELECT model FROM (SELECT *, rank() OVER (PARTITION BY {KEYS} ORDER BY aic) AS r FROM fits WHERE aic IS NOT NULL) WHERE r = 1),
t AS (SELECT model, count(*) AS n FROM best GROUP BY ALL)
SELECT model, n, round_even(100.0::DOUBLE * n / (SELECT sum(n) FROM t), 0) AS percent FROM t""")
def model_share(spark, folder):
    return models.model_share(_share_fits(spark, folder), GROUP)


@query(f"""
WITH {SHARE_FITS} SELECT class_age, model, round(median(aic), 4) AS median_aic, count(aic) AS n FROM fits
WHERE aic IS NOT NULL GROUP BY ALL""")
def aic_median(spark, folder):
    out = models.median_scores(_share_fits(spark, folder, cut=cut_lineage), ["class_age", "model"])
    return out.withColumn("median_aic", F.round("median_aic", 4))


@query(f"""
WITH {MASS_FITS}, long AS (
  SELECT site, term, estimate FROM (SELECT * FROM fits WHERE model = 'Logistic' AND aic IS NOT NULL)
  UNPIVOT (estimate FOR term IN (a, b, c, d)))
SELECT site, term, round(median(estimate), 6) AS median, count(*) AS n FROM long GROUP BY ALL""")
def param_median(spark, folder):
    fits = _mass_fits(spark, folder, (LOGISTIC,), cut=cut_lineage).filter("aic IS NOT NULL")
    long = models.parameters_long(fits, GROUP)
    return models.parameter_medians(long, ["site"]).withColumn("median", F.round("median", 6))


@query(f"""
WITH {SHARE_FITS}
SELECT {KEYS}, model, x::INT AS DOY, round({curve_value('x')}, 6) AS fitted,
       CASE WHEN aic IS NULL THEN 'no' ELSE 'yes' END AS aic_compiled
FROM fits, range(65, 338) r(x)""")
def predict_grid(spark, folder):
    out = predict.predict_days(_share_fits(spark, folder))
    return out.select(*GROUP, "model", "DOY", F.round("fitted", 6).alias("fitted"),
                      models.has_score(F.col("aic")).alias("aic_compiled"))


@query(f"""
WITH {SHARE_FITS}
SELECT {KEYS}, DOY, round({curve_value('DOY')}, 6) AS fitted, round(share - {curve_value('DOY')}, 6) AS resid
FROM curves JOIN fits USING ({KEYS}) WHERE model = 'Logistic'""")
def residuals(spark, folder):
    out = predict.residuals(_share_fits(spark, folder, (LOGISTIC,)), tables.order_curves(spark, folder), GROUP, "DOY", "share")
    return out.select(*GROUP, "DOY", F.round("fitted", 6).alias("fitted"), F.round("resid", 6).alias("resid"))


@query(f"""
WITH {SHARE_FITS}, bad AS (SELECT * FROM fits WHERE aic IS NULL OR NOT converged)
SELECT DISTINCT {KEYS}, DOY, round(share, 6) AS share FROM curves SEMI JOIN bad USING ({KEYS})""")
def invalid_fit_points(spark, folder):
    fits = _share_fits(spark, folder)
    bad = fits.filter(F.col("aic").isNull() | ~F.col("converged"))
    points = predict.observed_of(bad, tables.order_curves(spark, folder), GROUP)
    return points.select(*GROUP, "DOY", F.round("share", 6).alias("share"))


@query(f"""
WITH {SHARE_FITS}, bad AS (SELECT {KEYS}, model FROM fits WHERE NOT converged)
SELECT {KEYS}, model, x::INT AS DOY, round({curve_value('x')}, 6) AS fitted
FROM fits JOIN bad USING ({KEYS}, model), range(65, 338) r(x)""")
def unsettled_predictions(spark, folder):
    out = predict.predict_days(models.unsettled(_share_fits(spark, folder)))
    return out.select(*GROUP, "model", "DOY", F.round("fitted", 6).alias("fitted"))


def _odd_fits(spark, folder):
    return fit_curves(tables.odd_curves(spark, folder), GROUP, "DOY", "share", SHARE_BOX, tie_digits=SHARE_TIES)


@query(f"""
WITH {ODD_FITS}
SELECT {KEYS}, model, x::INT AS DOY, round({curve_value('x')}, 6) AS fitted,
       CASE WHEN aic IS NULL THEN 'no' ELSE 'yes' END AS aic_compiled
FROM fits, range(65, 338) r(x)""")
def odd_predict_grid(spark, folder):
    """Predictions of all fits, of which a fifth have no score."""
    out = predict.predict_days(_odd_fits(spark, folder))
    return out.select(*GROUP, "model", "DOY", F.round("fitted", 6).alias("fitted"),
                      models.has_score(F.col("aic")).alias("aic_compiled"))


@query(f"""
WITH {ODD_FITS}, best AS (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY {KEYS} ORDER BY aic) AS r FROM fits WHERE aic IS NOT NULL) WHERE r = 1)
SELECT {KEYS}, model, round(aic, 4) AS aic FROM best""")
def odd_best_models(spark, folder):
    """The chosen model of each group that has one: groups without a score take part in no selection."""
    best = best_rows(_odd_fits(spark, folder), GROUP, "aic")
    return best.select(*GROUP, "model", F.round("aic", 4).alias("aic"))


@query(f"""
WITH {ODD_FITS}, bad AS (SELECT * FROM fits WHERE aic IS NULL OR NOT converged)
SELECT DISTINCT {KEYS}, DOY, round(share, 6) AS share FROM odd SEMI JOIN bad USING ({KEYS})""")
def odd_invalid_points(spark, folder):
    """The observations behind fits that have no score or did not settle."""
    bad = _odd_fits(spark, folder).filter(F.col("aic").isNull() | ~F.col("converged"))
    points = predict.observed_of(bad, tables.odd_curves(spark, folder), GROUP)
    return points.select(*GROUP, "DOY", F.round("share", 6).alias("share"))


@query(f"""
WITH {ODD_FITS}
SELECT {KEYS}, model, x::INT AS DOY, round({curve_value('x')}, 6) AS fitted
FROM fits, range(65, 338) r(x) WHERE NOT converged""")
def odd_unsettled_predictions(spark, folder):
    """Predictions of the fits that did not settle."""
    out = predict.predict_days(models.unsettled(_odd_fits(spark, folder)))
    return out.select(*GROUP, "model", "DOY", F.round("fitted", 6).alias("fitted"))


@query(f"""
WITH {SHARE_FITS}
SELECT {KEYS}, round({curve_value('337')}, 6) AS fitted, 'Death' AS variable FROM fits WHERE model = 'Gompertz'""")
def season_snapshot(spark, folder):
    out = predict.predict_on(_share_fits(spark, folder, (GOMPERTZ,)), [337])
    return out.select(*GROUP, F.round("fitted", 6).alias("fitted"), F.lit("Death").alias("variable"))


@query(f"""
WITH {MASS_FITS}
SELECT {KEYS}, round({curve_value('65')}, 6) AS first_value, round({curve_value('337')}, 6) AS last_value,
       round({curve_value('337')} / nullif({curve_value('65')}, 0), 6) AS ratio
FROM fits WHERE model = 'Logistic'""")
def growth_ratio(spark, folder):
    out = predict.growth_ratio(predict.predict_on(_mass_fits(spark, folder, (LOGISTIC,)), [65, 337]), GROUP)
    return out.withColumns({c: F.round(c, 6) for c in ("first_value", "last_value", "ratio")})


@query(f"""
WITH {SHARE_FITS}, {fits_sql('curves', 'DOY', 'mass', MASS_BOX, name='mfits')}, {base.NATIONS}
SELECT site, class_age, campaign, fitted, variable, name, zone FROM (
  SELECT {KEYS}, round({curve_value('337')}, 6) AS fitted, 'Death' AS variable FROM fits WHERE model = 'Gompertz'
  UNION ALL
  SELECT {KEYS}, round({curve_value('337')} / nullif({curve_value('65')}, 0), 6), 'Growth' FROM mfits WHERE model = 'Logistic')
LEFT JOIN sites USING (site)""")
def indicator_pairs(spark, folder):
    pairs = _paired_fits(spark, folder)
    at = lambda name, day: predict.curve_at(name, F.lit(day))
    rows = F.array(
        F.when(F.col("share").isNotNull(), F.struct(at("share", 337).alias("fitted"), F.lit("Death").alias("variable"))),
        F.when(F.col("mass").isNotNull(), F.struct(ratio(at("mass", 337), at("mass", 65)).alias("fitted"),
                                                  F.lit("Growth").alias("variable"))))
    both = pairs.select(*GROUP, F.inline(F.array_compact(rows))).withColumn("fitted", F.round("fitted", 6))
    return join_keys(both, tables.nations(spark, folder), ["site"], "left")


@query(f"""
WITH {SHARE_FITS}, {fits_sql('curves', 'DOY', 'mass', MASS_BOX, name='mfits')}, {base.NATIONS},
r AS (SELECT {KEYS}, x::INT AS DOY, {curve_value('x')} AS v FROM fits, range(65, 338) t(x) WHERE model = 'Gompertz'),
m AS (SELECT {KEYS}, x::INT AS DOY, {curve_value('x')} AS v FROM mfits, range(65, 338) t(x) WHERE model = 'Logistic')
SELECT site, campaign, class_age, DOY, round(r.v, 3) AS CM_pred, round(m.v, 2) AS mass_pred, name, zone
FROM r FULL JOIN m USING (site, campaign, class_age, DOY) JOIN sites USING (site)""")
def combined_predictions(spark, folder):
    return predict.publish_pairs(_paired_fits(spark, folder), tables.nations(spark, folder), GROUP, "site", "share", "mass")


@query(f"""
WITH {SHARE_FITS}, e AS (SELECT class_age, model, min(aic) AS lo, max(aic) AS hi FROM fits WHERE aic IS NOT NULL GROUP BY ALL)
SELECT class_age, model, bin, count(*) AS n, round(lo + (hi - lo) * (bin - 1) / 60, 4) AS bin_start FROM (
  SELECT class_age, model, lo, hi, least(floor((aic - lo) / (hi - lo) * 60) + 1, 60)::INT AS bin
  FROM fits JOIN e USING (class_age, model) WHERE aic IS NOT NULL) GROUP BY ALL""")
def aic_histogram(spark, folder):
    out = models.histogram(_share_fits(spark, folder, cut=_one_search), ["class_age", "model"], "aic", 60)
    return out.withColumn("bin_start", F.round("bin_start", 4))


@query(f"""
WITH {SHARE_FITS}, long AS (
  SELECT site, term, estimate FROM (SELECT * FROM fits WHERE model = 'Gompertz' AND aic IS NOT NULL)
  UNPIVOT (estimate FOR term IN (a, b, c))),
e AS (
  SELECT site, term, min(estimate) AS lo, max(estimate) AS hi, 0.9::DOUBLE * stddev_samp(estimate) * pow(count(*), -0.2) AS h
  FROM long GROUP BY ALL),
binned AS (
  SELECT site, term, lo, hi, h, least(floor((estimate - lo) / ((hi - lo) / 1024)), 1023) AS slot, count(*) AS n
  FROM long JOIN (SELECT * FROM e WHERE hi > lo AND h > 0) USING (site, term) GROUP BY ALL),
k AS (
  SELECT site, term, p::INT AS point, lo + (hi - lo) * p / 127 AS x,
         sum(n * exp(-0.5 * pow((lo + (hi - lo) * p / 127 - (lo + (slot + 0.5) * (hi - lo) / 1024)) / h, 2))) AS v
  FROM binned, range(128) t(p) GROUP BY ALL)
SELECT site, term, point, round(x, 6) AS x, round(v / max(v) OVER (PARTITION BY site, term), 6) AS scaled FROM k""")
def param_density(spark, folder):
    fits = _share_fits(spark, folder, (GOMPERTZ,), cut=_one_search).filter("aic IS NOT NULL")
    long = models.parameters_long(fits, GROUP)
    out = models.scaled_density(long, ["site", "term"], "estimate")
    return out.withColumns({"x": F.round("x", 6), "scaled": F.round("scaled", 6)})


@query(f"""
WITH {base.CURVES}, start AS (
  SELECT {KEYS}, max(mass) AS a, min(CASE WHEN share >= 0.5 THEN DOY END)::DOUBLE AS c FROM curves GROUP BY ALL)
SELECT {KEYS}, b, model, x::INT AS x, round({curve_value('x', d='NULL')}, 6) AS y
FROM start, (VALUES (0.05::DOUBLE), (0.1), (1.0)) s(b), (VALUES ('Logistic'), ('Gompertz')) m(model), range(1, 366) t(x)""")
def curve_samples(spark, folder):
    start = tables.order_curves(spark, folder).groupBy(*GROUP).agg(
        F.max("mass").alias("a"), F.min(F.when(F.col("share") >= 0.5, F.col("DOY"))).cast("double").alias("c"))
    swept = start.withColumn("b", F.explode(F.array(*[F.lit(v) for v in (0.05, 0.1, 1.0)])))
    return predict.curve_samples(swept).select(*GROUP, "b", "model", "x", F.round("y", 6).alias("y"))
