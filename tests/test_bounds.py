"""Bounds of residual sums, proofs and lattice fits against sampled curves and brute force."""

import random

import numpy as np
import pytest

from tidemark.operators.bounds import best_on_lattice, derivatives, lower_bounds, prove
from tidemark.operators.fit import Box, _asymptotes, _search_group, fit_curves, fit_lattice

THREE = Box(a=(0, 40), b=(0, 0.2), c=(0, 365))
FOUR = Box(a=(0, 40), b=(0, 0.2), c=(0, 365), d=(0, 20))
BOXES = pytest.mark.parametrize("box", [THREE, FOUR])
MODELS = pytest.mark.parametrize("model", ["Logistic", "Gompertz"])
# the valley that ends lowest is the fourth of the first grid
X = [40, 80, 135, 175, 230, 245, 255, 260, 275, 290, 295]
Y = [6, 3, 14, 21, 24, 26, 29, 30, 39, 40, 44]
STEEP = Box(a=(0, 70), b=(0, 2.0), c=(0, 365))


def series(rng, points=11):
    """Sums of days: number of rows, values, squares; some days hold several rows."""
    x = np.sort(rng.choice(366, points, replace=False)).astype(float)
    n = rng.integers(1, 4, points)
    rows = [rng.uniform(0, 3, k) + 25 * (at > 180) * rng.uniform(0.5, 1) for k, at in zip(n, x)]
    return x, n.astype(float), np.array([r.sum() for r in rows]), np.array([(r * r).sum() for r in rows])


def plain_rss(days, model, a, b, c, d):
    x, n, sy, syy = days
    f = derivatives(model, b * (x - c))[0]
    return float((syy - 2 * sy * (d + a * f) + n * (d + a * f) ** 2).sum())


@MODELS
def test_derivatives(model):
    u, h = np.linspace(-6, 6, 121), 1e-5
    f, first, second = derivatives(model, u)
    up, down = derivatives(model, u + h), derivatives(model, u - h)
    assert np.abs((up[0] - down[0]) / (2 * h) - first).max() < 1e-8
    assert np.abs((up[1] - down[1]) / (2 * h) - second).max() < 1e-8
    assert all(np.isfinite(v).all() for v in derivatives(model, np.array([-1e6, 1e6])))


@BOXES
@MODELS
def test_no_curve_of_a_cell_goes_below_its_bound(box, model):
    rng = np.random.default_rng(1)
    for _ in range(40):
        days = series(rng)
        size = 10.0 ** rng.uniform(-3, 0)
        b0, c0 = rng.uniform(0, 0.2 * (1 - size)), rng.uniform(0, 365 * (1 - size))
        cell = (b0, b0 + 0.2 * size, c0, c0 + 365 * size)
        low = lower_bounds(box, model, days, tuple(np.array([v]) for v in cell), 1e9, _asymptotes)[5][0]
        for _ in range(60):
            b, c = rng.uniform(cell[0], cell[1]), rng.uniform(cell[2], cell[3])
            f = derivatives(model, b * (days[0] - c))[0]
            x, n, sy, syy = days
            rss, a, d = _asymptotes(box, n.sum(), np.array([f @ n]), np.array([(f * f) @ n]), sy.sum(), np.array([f @ sy]), syy.sum())
            assert rss[0] == pytest.approx(plain_rss(days, model, a[0], b, c, d[0]), abs=1e-6)
            assert rss[0] >= low - 1e-9
        exact = lower_bounds(box, model, days, tuple(np.array([v]) for v in (b, b + 1e-9, c, c + 1e-6)), 1e9, _asymptotes)
        assert exact[5][0] == pytest.approx(exact[0][0], rel=1e-3, abs=1e-3)  # a small cell is bounded tightly


@BOXES
@MODELS
def test_proofs_hold_against_dense_grids(box, model):
    rng = np.random.default_rng(2)
    for _ in range(12):
        days = series(rng)
        *fit, _, proven = _search_group(box, model, *days, 5, 25, 9, 3, 1e-3, 200_000)
        b, c = np.repeat(np.linspace(0, 0.2, 150), 150), np.tile(np.linspace(0, 365, 150), 150)
        f = derivatives(model, b[:, None] * (days[0][None, :] - c[:, None]))[0]
        x, n, sy, syy = days
        rss = _asymptotes(box, n.sum(), f @ n, (f * f) @ n, sy.sum(), f @ sy, syy.sum())[0]
        assert proven <= fit[4] <= proven * (1 + 2e-3) + 1e-6
        assert proven <= np.nanmin(rss) + 1e-9 and fit[4] <= np.nanmin(rss) * (1 + 1e-3)
        assert fit[4] == pytest.approx(plain_rss(days, model, *fit[:4]), rel=1e-6)


def frame(spark, points):
    return spark.createDataFrame([(g, x, float(y)) for g, xy in points.items() for x, y in xy], "g string, x int, y double")


def test_a_fit_in_the_fourth_valley_is_found(spark):
    df = frame(spark, {"s": list(zip(X, Y))})
    fit = lambda **options: fit_curves(df, ["g"], "x", "y", STEEP, models=("Logistic",), **options).first()
    assert fit(top=3).rss > 1.2 * fit(top=4).rss  # three valleys miss it
    proven = fit(prove=True)
    assert proven.gap == 0 and proven.rss <= 1.001 * fit(top=4).rss
    assert "gap" not in fit(top=3).asDict()


def test_a_search_cut_short_says_so(spark):
    df = frame(spark, {"s": list(zip(X, Y))})
    row = fit_curves(df, ["g"], "x", "y", STEEP, models=("Logistic",), prove=True, most=700).first()
    done = fit_curves(df, ["g"], "x", "y", STEEP, models=("Logistic",), prove=True).first()
    assert row.gap > 0 and row.rss - row.gap <= done.rss


def test_noise_without_growth_is_bounded_not_proven(spark):
    """All curves explain about the same of it, so a proof would have to visit the whole box finely."""
    noise = [(x, random.Random(x).random()) for x in range(65, 338, 21)]
    rows = fit_curves(frame(spark, {"noise": noise}), ["g"], "x", "y", FOUR, prove=True, most=5_000).collect()
    spread = sum((y - sum(v for _, v in noise) / len(noise)) ** 2 for _, y in noise)
    assert all(0 <= r.gap <= r.rss + 1e-9 and r.rss <= spread + 1e-9 for r in rows) and any(r.gap > 0 for r in rows)


def test_flat_perfect_and_short_series_are_proven(spark):
    days = range(65, 338, 21)
    curve = lambda x: 35 / (1 + np.exp(-0.05 * (x - 182.5)))
    points = {"zero": [(x, 0) for x in days], "flat": [(x, 12.5) for x in days], "exact": [(x, curve(x)) for x in days],
              "one": [(100, 5)], "two": [(100, 5), (200, 9)], "repeats": [(x, curve(x) + random.Random(x + i).random()) for x in days for i in range(40)]}
    for box in (THREE, FOUR):
        rows = fit_curves(frame(spark, points), ["g"], "x", "y", box, prove=True).collect()
        assert len(rows) == 12 and all(r.gap == 0 for r in rows)


@BOXES
@MODELS
def test_lattice_fits_equal_brute_force(box, model):
    rng = np.random.default_rng(3)
    seen_all = []
    for steps in ((101, 74), (17, 5), (2, 2), (40, 33)):
        for _ in range(4):
            days = series(rng, int(rng.integers(1, 14)))
            found, seen = best_on_lattice(box, model, days, steps, 6, _asymptotes)
            b, c = np.repeat(0.2 * np.arange(steps[0]) / (steps[0] - 1), steps[1]), np.tile(365 * np.arange(steps[1]) / (steps[1] - 1), steps[0])
            f = derivatives(model, b[:, None] * (days[0][None, :] - c[:, None]))[0]
            x, n, sy, syy = days
            rss, a, d = _asymptotes(box, n.sum(), f @ n, (f * f) @ n, sy.sum(), f @ sy, syy.sum())
            i = np.lexsort((c, b, np.round(np.where(np.isnan(rss), np.inf, rss), 6)))[0]
            assert found == pytest.approx((a[i], b[i], c[i], d[i], rss[i]), rel=1e-9, abs=1e-9)
            if steps[0] > 100 and len(x) > 8:
                seen_all.append(seen)
    assert max(seen_all) < 0.4 * 101 * 74


def test_lattice_table(spark):
    rows = fit_lattice(frame(spark, {"s": list(zip(X, Y)), None: [(100, 2.0)]}), ["g"], "x", "y", STEEP, 21, 30).collect()
    assert {(r.g, r.model) for r in rows} == {(g, m) for g in ("s", None) for m in ("Logistic", "Gompertz")}
    assert all(r.d is None and r.visited <= 2 * 21 * 30 for r in rows)
    assert fit_lattice(frame(spark, {}), ["g"], "x", "y", STEEP, 21, 30).count() == 0


def test_proof_never_worsens_a_fit():
    rng = np.random.default_rng(5)
    better = 0
    for _ in range(30):
        days = series(rng, 8)
        plain = _search_group(FOUR, "Gompertz", *days, 5, 25, 9, 3)
        found = _search_group(FOUR, "Gompertz", *days, 5, 25, 9, 3, 1e-3, 200_000)
        assert found[4] <= plain[4] + 1e-12
        better += found[4] < 0.999 * plain[4]
    assert better  # windows around the lowest valleys lose some of them
    assert prove(THREE, "Logistic", (np.array([1.0]), np.array([1.0]), np.array([2.0]), np.array([4.0])), (2.0, 0.1, 0.0, 0.0, 0.0),
                 1e-3, 10, None, _asymptotes)[1] == 0
