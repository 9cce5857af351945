import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import predict
from tidemark.operators.fit import Box, Spec, fit_curves, fit_series

THREE = Box(a=(0, 70), b=(0, 0.2), c=(0, 365))
FOUR = Box(a=(0, 86), b=(0, 0.2), c=(0, 365), d=(0, 69))
DAYS = range(65, 338, 21)


def logistic(a, b, c, d=0.0):
    return lambda x: d + a / (1 + math.exp(-b * (x - c)))


def gompertz(a, b, c, d=0.0):
    return lambda x: d + a * math.exp(-math.exp(-b * (x - c)))


def frame(spark, series):
    rows = [(*(g if isinstance(g, tuple) else (g, 2000)), x, float(y)) for g, points in series.items() for x, y in points]
    return spark.createDataFrame(rows, "site string, campaign int, DOY int, y double")


def fit(spark, series, box, **options):
    out = fit_curves(frame(spark, series), ["site", "campaign"], "DOY", "y", box, **options)
    return {(r.site, r.model): r for r in out.collect()}


def test_recovers_the_generating_curve(spark):
    got = fit(spark, {"l": [(x, logistic(40, .03, 200)(x)) for x in DAYS], "g": [(x, gompertz(50, .02, 170)(x)) for x in DAYS]},
              THREE, rounds=9)
    l, g = got["l", "Logistic"], got["g", "Gompertz"]
    assert (l.a, l.b, l.c) == pytest.approx((40, .03, 200), rel=1e-3)
    assert (g.a, g.b, g.c) == pytest.approx((50, .02, 170), rel=1e-3)
    assert l.rss < 1e-4 and got["l", "Gompertz"].rss > l.rss and l.d is None and l.k == 3


def test_four_parameters_and_null_keys(spark):
    series = {(None, 2000): [(x, logistic(30, .04, 190, 25)(x)) for x in DAYS],
              ("g", 2000): [(x, gompertz(45, .03, 160, 10)(x)) for x in DAYS]}
    got = fit(spark, series, FOUR, rounds=8)
    l, g = got[None, "Logistic"], got["g", "Gompertz"]
    assert (l.a, l.b, l.c, l.d) == pytest.approx((30, .04, 190, 25), rel=5e-3)
    assert (g.a, g.b, g.c, g.d) == pytest.approx((45, .03, 160, 10), rel=5e-3)


def test_perfect_and_flat_series(spark):
    cell = logistic(35.0, 0.2 * 6 / 24, 365 * 12 / 24)  # parameters on the grid
    got = fit(spark, {"exact": [(x, cell(x)) for x in DAYS], "zero": [(x, 0) for x in DAYS], "flat": [(x, 12.5) for x in DAYS]},
              THREE)
    assert got["exact", "Logistic"].aic is None and got["exact", "Logistic"].converged
    assert got["exact", "Gompertz"].aic is not None
    for model in ("Logistic", "Gompertz"):
        assert got["zero", model].rss == 0 and got["zero", model].aic is None
        assert got["flat", model].rss == pytest.approx(0, abs=1e-9)


def test_parameters_stay_in_the_box(spark):
    random.seed(2)
    series = {f"s{i}": [(x, random.uniform(0, 200)) for x in DAYS] for i in range(6)}
    series["steep"] = [(x, 300 if x > 150 else -20) for x in DAYS]
    for box in (THREE, FOUR):
        for r in fit(spark, series, box).values():
            for name in ("a", "b", "c", "d"):
                bounds = getattr(box, name)
                if bounds:
                    assert bounds[0] <= r[name] <= bounds[1]


def test_few_points(spark):
    got = fit(spark, {"one": [(100, 5)], "two": [(100, 5), (200, 9)]}, FOUR)
    assert all(r.rss == pytest.approx(0, abs=1e-6) for r in got.values())


def test_rounds_never_raise_the_rss_and_beat_random_starts(spark):
    random.seed(4)
    series = {}
    for i in range(5):
        f = gompertz(random.uniform(20, 60), random.uniform(.01, .05), random.uniform(130, 260), random.uniform(2, 40))
        series[f"s{i}"] = [(x, f(x) + random.gauss(0, 1)) for x in DAYS]
    by_round = [fit(spark, series, FOUR, rounds=r) for r in (1, 2, 3, 5)]
    for before, after in zip(by_round, by_round[1:]):
        assert all(after[k].rss <= before[k].rss + 1e-9 for k in before)
    for (site, model), r in by_round[-1].items():
        shape = logistic if model == "Logistic" else gompertz
        points = series[site]
        for _ in range(400):
            a, b, c, d = (random.uniform(*v) for v in (FOUR.a, FOUR.b, FOUR.c, FOUR.d))
            assert r.rss <= sum((y - shape(a, b, c, d)(x)) ** 2 for x, y in points) + 1e-9


def test_more_valleys_never_fit_worse(spark):
    random.seed(9)
    series = {f"s{i}": [(x, (5 if x > 110 else 0) + (20 if x > 290 else 0) + random.uniform(-2, 2)) for x in DAYS] for i in range(6)}
    one, three = fit(spark, series, THREE, top=1), fit(spark, series, THREE, top=3)
    assert all(three[k].rss <= one[k].rss + 1e-9 for k in one)


def test_repeated_days_count_as_single_rows(spark):
    random.seed(6)
    points = [(x, logistic(40, .03, 200)(x) + random.gauss(0, 2)) for x in DAYS for _ in range(50)]
    r = fit(spark, {"hot": points}, THREE, models=("Logistic",))["hot", "Logistic"]
    direct = sum((y - logistic(r.a, r.b, r.c)(x)) ** 2 for x, y in points)
    assert r.n == len(points) and r.rss == pytest.approx(direct)
    assert r.aic == pytest.approx(r.n * (math.log(2 * math.pi) + 1 - math.log(r.n) + math.log(direct)) + 8)


def test_missing_values_and_wrong_days(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", None, 3.0)], "g string, x int, y double")
    assert {r.n for r in fit_curves(df, ["g"], "x", "y", THREE).collect()} == {1}
    with pytest.raises(TypeError):
        fit_curves(df.withColumn("x", F.col("x") + 0.5), ["g"], "x", "y", THREE)


def test_predictions(spark):
    observed = frame(spark, {"a": [(x, logistic(30, .04, 190, 25)(x)) for x in DAYS]})
    fits = fit_curves(observed, ["site", "campaign"], "DOY", "y", FOUR, models=("Logistic",), rounds=8)
    days = predict.predict_days(fits).cache()
    assert days.count() == 273 and {r.DOY for r in days.collect()} == set(range(65, 338))
    ratio = predict.growth_ratio(days, ["site", "campaign"]).first()
    assert ratio.ratio == pytest.approx(logistic(30, .04, 190, 25)(337) / logistic(30, .04, 190, 25)(65), rel=1e-3)
    resid = predict.residuals(fits, observed, ["site", "campaign"], "DOY", "y").collect()
    assert len(resid) == len(DAYS) and max(abs(r.resid) for r in resid) < 0.05


def test_several_series_are_fitted_in_one_pass(spark):
    random.seed(8)
    one, two = ({g: [(x, f(x) + random.gauss(0, .5)) for x in DAYS] for g in ("a", "b")}
                for f in (logistic(40, .03, 200), gompertz(45, .03, 160, 10)))
    long = frame(spark, one).withColumn("kind", F.lit("three")).unionByName(
        frame(spark, two).withColumn("kind", F.lit("four"))).unionByName(frame(spark, one).withColumn("kind", F.lit("unknown")))
    specs = {"three": Spec(THREE, ("Logistic",)), "four": Spec(FOUR)}
    fits = fit_series(long, ["site", "campaign"], "kind", "DOY", "y", specs)
    assert fits._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    got = {(r.site, r.kind, r.model): r for r in fits.collect()}
    assert set(got) == {(g, k, m) for g in ("a", "b") for k, m in (("three", "Logistic"), ("four", "Logistic"), ("four", "Gompertz"))}
    for kind, series, box in (("three", one, THREE), ("four", two, FOUR)):
        for (site, model), r in fit(spark, series, box).items():
            if (site, kind, model) in got:
                same = got[site, kind, model]
                assert (same.a, same.b, same.c, same.d, same.k, same.aic) == (r.a, r.b, r.c, r.d, r.k, r.aic)
    pairs = predict.side_by_side(fits.filter("model = 'Logistic'"), ["site", "campaign"], "kind", ["three", "four", "none"])
    for r in pairs.withColumn("v", predict.curve_at("three", F.lit(200))).withColumn("w", predict.curve_at("none", F.lit(1))).collect():
        p = got[r.site, "three", "Logistic"]
        assert r.v == pytest.approx(logistic(p.a, p.b, p.c)(200)) and r.w is None and r.none is None
