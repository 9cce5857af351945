"""Bounded least-squares fits of sigmoid curves to every group at once.

For a given slope and midpoint the curve is linear in its asymptotes, so these have a closed form
(variable projection) and only the plane of slope and midpoint is searched: a grid over the box, then
finer grids around the best cell. Spark sums the observations to days, brings a group's days together
as one short array and spreads the groups; only the grid search inside a group is numpy, over Arrow
batches of groups. A first, untuned version over exploded grid rows and one with higher-order functions
over the arrays were both several times slower (figures in the README).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from tidemark.functions import curves
from tidemark.functions.curves import LOGISTIC
from tidemark.operators.bounds import ROUNDING, best_on_lattice, prove
from tidemark.session import wide_parallelism

# the search travels inside the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


ROUNDS, STEPS, VALLEYS, TIE_DIGITS = 5, 25, 3, 9
MOST_CELLS = 60_000


@dataclass(frozen=True)
class Box:
    """Parameter bounds. ``d`` is the base; the three-parameter curves have none."""

    a: tuple[float, float]
    b: tuple[float, float]
    c: tuple[float, float]
    d: tuple[float, float] | None = None

    @property
    def parameters(self) -> int:
        return 3 if self.d is None else 4


@dataclass(frozen=True)
class Spec:
    """What to fit to one kind of series: the box, the models, and the digits that tell residual sums apart."""

    box: Box
    models: tuple[str, ...] = curves.MODELS
    tie_digits: int = TIE_DIGITS


def _asymptotes(box: Box, n, sf, sff, sy, sfy, syy):
    """Best ``rss, a, d`` for every cell, given the sums of its curve with the data; NaN when undetermined."""
    if box.d is None:
        a = np.clip(sfy / np.where(sff == 0, np.nan, sff), *box.a)
        return np.maximum(syy - 2 * a * sfy + a * a * sff, 0.0), a, np.zeros_like(a)
    # inner optimum, kept when it lies in the box; else the optimum is on one of the four edges.
    # A curve that is flat over the observed days cannot tell `a` from `d`: edges only.
    det = n * sff - sf * sf
    inner_a = (n * sfy - sf * sy) / np.where(det > n * sff * 1e-12, det, np.nan)
    inner_d = (sy - inner_a * sf) / n
    inside = (inner_a >= box.a[0]) & (inner_a <= box.a[1]) & (inner_d >= box.d[0]) & (inner_d <= box.d[1])
    options = [(np.where(inside, inner_a, np.nan), np.where(inside, inner_d, np.nan))]
    options += [(np.full_like(sf, e), np.clip((sy - e * sf) / n, *box.d)) for e in box.a]
    options += [(np.clip((sfy - e * sf) / np.where(sff == 0, np.nan, sff), *box.a), np.full_like(sf, e)) for e in box.d]
    a, d = np.array([o[0] for o in options]), np.array([o[1] for o in options])
    rss = np.maximum(syy - 2 * a * sfy - 2 * d * sy + a * a * sff + 2 * a * d * sf + n * d * d, 0.0)
    pick = np.argmin(np.where(np.isnan(rss), np.inf, rss), axis=0), np.arange(sf.size)
    return rss[pick], a[pick], d[pick]


def _valleys(rss: np.ndarray, steps: int, top: int) -> np.ndarray:
    """The lowest cells of the whole-box grid that no neighbour undercuts, at most ``top``, best first."""
    height = np.pad(rss.reshape(steps, steps), 1, constant_values=np.inf)
    around = [height[1 + i:steps + 1 + i, 1 + j:steps + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    low = np.flatnonzero((rss <= np.min(around, axis=0).ravel()) & np.isfinite(rss))
    return low[np.argsort(rss[low], kind="stable")][:top]


def _search_group(box: Box, model: str, x, n, sy, syy, rounds: int, steps: int, tie_digits: int, top: int,
                  tolerance: float | None = None, most: int = MOST_CELLS):
    """``a, b, c, d``, the RSS of the last round and of the one before it, for one group's days.

    With a ``tolerance`` also a sum of squares that is proven to be the least possible or less; a better fit that the proof
    meets takes the place of the first one.
    """
    last = steps - 1
    total_n, total_y, total_yy = n.sum(), sy.sum(), syy.sum()

    def grid(b0, b1, c0, c1):
        return (np.repeat(b0 + (b1 - b0) * np.arange(steps) / last, steps),
                np.tile(c0 + (c1 - c0) * np.arange(steps) / last, steps))

    def solve(b, c):
        growth = np.exp(-b[:, None] * (x[None, :] - c[:, None]))
        f = 1 / (1 + growth) if model == LOGISTIC else np.exp(-growth)
        rss, a, d = _asymptotes(box, total_n, f @ n, (f * f) @ n, total_y, f @ sy, total_yy)
        # least RSS, ties to the smallest slope, then midpoint; undetermined cells come last
        rss = np.where(np.isnan(rss), np.inf, rss)
        return rss, a, d, np.lexsort((c, b, np.round(rss, tie_digits)))[0]

    def refine(start, half_b=(box.b[1] - box.b[0]) / last * 1.5, half_c=(box.c[1] - box.c[0]) / last * 1.5):
        best, before = start, None
        for _ in range(rounds - 1):
            # one and a half cells to each side, cut at the box; the best cell so far stays a candidate
            b, c = grid(max(best[1] - half_b, box.b[0]), min(best[1] + half_b, box.b[1]),
                        max(best[2] - half_c, box.c[0]), min(best[2] + half_c, box.c[1]))
            b, c, before = np.append(b, best[1]), np.append(c, best[2]), best[4]
            rss, a, d, i = solve(b, c)
            best = a[i], b[i], c[i], d[i], rss[i]
            half_b, half_c = half_b * 3 / last, half_c * 3 / last
        return *best, before

    b, c = grid(*box.b, *box.c)
    rss, a, d, first = solve(b, c)
    if not np.isfinite(rss[first]):
        return None
    starts = [first] + [i for i in _valleys(rss, steps, top) if i != first][:top - 1]
    found = [refine((a[i], b[i], c[i], d[i], rss[i])) for i in starts]
    best = min(found, key=lambda r: (round(r[4], tie_digits), r[1], r[2]))
    if tolerance is None:
        return *best, None
    best, proven = prove(box, model, (x, n, sy, syy), best, tolerance, most, refine, _asymptotes)
    return *best, proven


def _group_days(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One row per group with the sums of its days as an array, spread over the tasks."""
    if not isinstance(df.schema[x].dataType, IntegralType):
        raise TypeError(f"{x} must hold whole days, not {df.schema[x].dataType.simpleString()}")
    daily = (
        df.select(F.struct(*keys).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("g", "x").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    )
    return (
        daily.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("x", "n", "sy", "syy"))).alias("pts"))
        .repartition(wide_parallelism(df.sparkSession), "g")
    )


def fit_lattice(df: DataFrame, keys: list[str], x: str, y: str, box: Box, slopes: int, midpoints: int,
                models: tuple[str, ...] = curves.MODELS, tie_digits: int = TIE_DIGITS) -> DataFrame:
    """The best of ``slopes`` x ``midpoints`` evenly spread points of the box, for each group and model.

    For published parameters of few digits: the result is exact, though bounds spare most points. ``visited`` counts
    the points that were looked at.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, days in zip(batch["g"], batch["pts"]):
                sums = tuple(np.array([day[k] for day in days]) for k in ("x", "n", "sy", "syy"))
                with np.errstate(all="ignore"):
                    for m in models:
                        found, seen = best_on_lattice(box, m, sums, (slopes, midpoints), tie_digits, _asymptotes)
                        if found is not None:
                            rows.append((key, m, *found, int(sums[1].sum()), seen))
            yield pd.DataFrame(rows, columns=["g", "model", "a", "b", "c", "d", "rss", "n", "visited"])

    groups = _group_days(df, keys, x, y)
    schema = StructType([groups.schema["g"]])
    for field in StructType.fromDDL("model string, a double, b double, c double, d double, rss double, n long, visited long"):
        schema = schema.add(field)
    base = F.lit(None).cast("double") if box.d is None else F.col("d")
    return groups.mapInPandas(search, schema).select(
        *[F.col("g")[k].alias(k) for k in keys], "model", "a", "b", "c", base.alias("d"), "rss", "n", "visited")


def fit_curves(df: DataFrame, keys: list[str], x: str, y: str, box: Box, models: tuple[str, ...] = curves.MODELS,
               rounds: int = ROUNDS, steps: int = STEPS, tie_digits: int = TIE_DIGITS, tolerance: float = 1e-3,
               perfect: float = 1e-12, top: int = VALLEYS, prove: bool = False, most: int = MOST_CELLS) -> DataFrame:
    """Fit each model to each group; one row per group and model.

    ``x`` counts days and is an integer. The observations are first summed to one row per group and day
    (combined before the shuffle), so a group's array is bounded by the calendar however many rows it
    has. The arrays are then spread by a partition count given by number: they are tiny in bytes but
    large in work, and AQE would fold them into one task.

    The first grid's lowest ``top`` valleys are refined. With ``prove`` a branch and bound over the whole box follows
    (see ``bounds``): it replaces the fit where another part of the box holds a better one, and the column ``gap`` tells by how
    much the least possible RSS may lie below the fit's: 0 where that is less than ``tolerance`` of it, which is proven; more
    only where ``most`` cells did not suffice.

    ``converged``: the last round improved the RSS by less than ``tolerance`` of itself. ``aic`` is NULL
    for a perfect fit (RSS at most ``perfect`` of the sum of squares).
    """
    specs = {None: Spec(box, models, tie_digits)}
    return _fitted(_group_days(df, keys, x, y), keys, None, specs, rounds, steps, tolerance, perfect, top, prove, most)


def fit_series(df: DataFrame, keys: list[str], series: str, x: str, y: str, specs: dict[str, Spec], rounds: int = ROUNDS,
               steps: int = STEPS, tolerance: float = 1e-3, perfect: float = 1e-12, top: int = VALLEYS, prove: bool = False,
               most: int = MOST_CELLS) -> DataFrame:
    """``fit_curves`` for several kinds of series in one pass: the column ``series`` names the spec of a row.

    The observations are read and shuffled once, and one stage searches all fits. Rows of a series without a spec are left out.
    """
    wanted = df.filter(F.col(series).isin(*specs))
    groups = _group_days(wanted, [*keys, series], x, y)
    return _fitted(groups, [*keys, series], series, specs, rounds, steps, tolerance, perfect, top, prove, most)


def _fitted(groups: DataFrame, keys: list[str], series: str | None, specs: dict, rounds: int, steps: int, tolerance: float,
            perfect: float, top: int, prove: bool, most: int) -> DataFrame:
    asked = tolerance if prove else None

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, days in zip(batch["g"], batch["pts"]):
                x, n, sy, syy = (np.array([day[k] for day in days]) for k in ("x", "n", "sy", "syy"))
                spec = specs[key[series] if series else None]
                with np.errstate(all="ignore"):
                    for m in spec.models:
                        found = _search_group(spec.box, m, x, n, sy, syy, rounds, steps, spec.tie_digits, top, asked, most)
                        if found is not None:
                            rows.append((key, list(days), m, *found))
            yield pd.DataFrame(rows, columns=["g", "pts", "model", "a", "b", "c", "d", "after", "before", "proven"])

    kinds = ", ".join(f"{k} double" for k in ("a", "b", "c", "d", "after", "before", "proven"))
    schema = StructType([groups.schema["g"], groups.schema["pts"]])
    for field in StructType.fromDDL(f"model string, {kinds}"):
        schema = schema.add(field)
    return _summary(groups.mapInPandas(search, schema), keys, series, specs, tolerance, perfect, prove)


def _summary(fits: DataFrame, keys: list[str], series: str | None, specs: dict, tolerance: float, perfect: float,
             prove: bool) -> DataFrame:
    """Direct residuals of the chosen curves (the summed form cancels near perfect fits), then AIC."""

    def squares(p: Column) -> Column:
        # rows of one day: spread around their mean plus the distance of the mean from the curve
        day_mean = p["sy"] / p["n"]
        gap = day_mean - curves.curve(F.col("model"), F.col("a"), F.col("b"), F.col("c"), p["x"], F.col("d"))
        spread = F.when(p["n"] > 1, F.greatest(p["syy"] - p["sy"] * day_mean, F.lit(0.0))).otherwise(F.lit(0.0))
        return spread + p["n"] * gap * gap

    direct = F.aggregate("pts", F.lit(0.0), lambda acc, p: acc + squares(p))
    fits = fits.withColumn("n", F.aggregate("pts", F.lit(0.0), lambda acc, p: acc + p["n"]))
    fits = fits.withColumn("syy", F.aggregate("pts", F.lit(0.0), lambda acc, p: acc + p["syy"]))
    rss = F.when(F.col("raw") > perfect * F.col("syy"), F.col("raw")).when(F.col("raw").isNotNull(), F.lit(0.0))
    settled = (F.col("rss") == 0) | ((F.col("before") - F.col("after")) <= tolerance * F.col("after"))
    of = lambda value: F.element_at(F.create_map(*[F.lit(v) for name, spec in specs.items() for v in (
        name, value(spec.box))]), F.col("g")[series]) if series else F.lit(value(next(iter(specs.values())).box))
    parameters = of(lambda box: box.parameters)
    base = F.when(of(lambda box: box.d is not None), F.col("d"))
    missing = F.col("after") - F.col("proven")
    surely = missing <= F.greatest(tolerance * F.col("after"), 4 * ROUNDING * F.col("syy"))
    gap = [F.when(surely, 0.0).otherwise(missing).alias("gap")] if prove else []
    return (
        fits.withColumn("raw", direct).withColumn("rss", rss)
        .select(*[F.col("g")[k].alias(k) for k in keys], "model", "a", "b", "c", base.alias("d"),
                F.col("n").cast("long").alias("n"), parameters.alias("k"), "rss",
                curves.least_squares_aic(F.col("n"), F.col("rss"), parameters).alias("aic"),
                F.coalesce(settled, F.lit(False)).alias("converged"), *gap)
    )
