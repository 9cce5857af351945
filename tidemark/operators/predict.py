"""Evaluating fitted curves: daily grids, residuals, snapshots and the published table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import curves
from tidemark.functions.nulls import ratio
from tidemark.operators.joins import join_keys
from tidemark.operators.reshape import pivot_values


def _value(x: str):
    return curves.curve(F.col("model"), F.col("a"), F.col("b"), F.col("c"), F.col(x).cast("double"), F.col("d"))


def predict_days(fits: DataFrame, first: int = 65, last: int = 337, x: str = "DOY", name: str = "fitted") -> DataFrame:
    """Every fit evaluated on each day of the range."""
    return fits.withColumn(x, F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(name, _value(x))


def predict_on(fits: DataFrame, days: list[int], x: str = "DOY", name: str = "fitted") -> DataFrame:
    """Every fit evaluated on the given days only."""
    return fits.withColumn(x, F.explode(F.array(*[F.lit(d) for d in days]))).withColumn(name, _value(x))


def residuals(fits: DataFrame, observed: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Observed values with the fitted ones and the difference.

    The observations are the large side; a group with many rows is split by AQE, never gathered.
    """
    return join_keys(observed, fits, keys).withColumn("fitted", _value(x)).withColumn("resid", F.col(y) - F.col("fitted"))


def observed_of(fits: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Observations of the groups that occur in ``fits``."""
    return join_keys(observed, fits, keys, "left_semi")


def snapshot(predictions: DataFrame, day: int, x: str = "DOY") -> DataFrame:
    return predictions.filter(F.col(x) == day)


def growth_ratio(predictions: DataFrame, keys: list[str], first: int = 65, last: int = 337, x: str = "DOY",
                 value: str = "fitted", name: str = "ratio") -> DataFrame:
    """Prediction on the last day over the one on the first."""
    wide = pivot_values(predictions.filter(F.col(x).isin(first, last)), keys, x, value, [first, last])
    return wide.select(*keys, F.col(str(first)).alias("first_value"), F.col(str(last)).alias("last_value"),
                       ratio(F.col(str(last)), F.col(str(first))).alias(name))


def curve_samples(curves_table: DataFrame, first: int = 1, last: int = 365, x: str = "x", name: str = "y") -> DataFrame:
    """Curves with given parameters on a range of days, each under both models."""
    rows = curves_table.withColumn("model", F.explode(F.array(*[F.lit(m) for m in curves.MODELS]))).withColumn(
        x, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.withColumn(name, curves.curve(F.col("model"), F.col("a"), F.col("b"), F.col("c"),
                                              F.col(x).cast("double")))


def side_by_side(fits: DataFrame, keys: list[str], series: str, names: list[str]) -> DataFrame:
    """One row per group with the curve of each named series as a struct, NULL where it has none; one curve per series."""
    curve = F.struct("model", "a", "b", "c", "d")
    return fits.groupBy(*keys).agg(*[F.max(F.when(F.col(series) == n, curve)).alias(n) for n in names])


def curve_at(name: str, x: Column) -> Column:
    """The value of a curve of ``side_by_side`` on a day."""
    p = F.col(name)
    return curves.curve(p["model"], p["a"], p["b"], p["c"], x.cast("double"), p["d"])


def publish_pairs(pairs: DataFrame, sites: DataFrame, keys: list[str], site: str, rate: str, mass: str, first: int = 65,
                  last: int = 337, x: str = "DOY") -> DataFrame:
    """Daily predictions of both curves of a group with the site's description, rounded for print. No join of predictions."""
    daily = pairs.withColumn(x, F.explode(F.sequence(F.lit(first), F.lit(last))))
    table = daily.select(*keys, x, F.round(curve_at(rate, F.col(x)), 3).alias("CM_pred"),
                         F.round(curve_at(mass, F.col(x)), 2).alias("mass_pred"))
    return join_keys(table, sites, [site])
