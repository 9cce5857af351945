"""Sigmoid curves and the AIC of a least-squares fit, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGISTIC = "Logistic"
GOMPERTZ = "Gompertz"
MODELS = (LOGISTIC, GOMPERTZ)


def unit_logistic(b: Column, c: Column, x: Column) -> Column:
    """Logistic curve between 0 and 1 with slope ``b`` and midpoint ``c``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-b * (x - c)))


def unit_gompertz(b: Column, c: Column, x: Column) -> Column:
    """Gompertz curve between 0 and 1 with slope ``b`` and inflection ``c``."""
    return F.exp(-F.exp(-b * (x - c)))


def unit_curve(model: Column | str, b: Column, c: Column, x: Column) -> Column:
    """Curve of the named model, or of the model each row names."""
    if isinstance(model, str):
        return {LOGISTIC: unit_logistic, GOMPERTZ: unit_gompertz}[model](b, c, x)
    return F.when(model == LOGISTIC, unit_logistic(b, c, x)).when(model == GOMPERTZ, unit_gompertz(b, c, x))


def curve(model: Column, a: Column, b: Column, c: Column, x: Column, d: Column | None = None) -> Column:
    """Upper asymptote ``a`` above the base ``d`` (0 for the three-parameter curves)."""
    y = a * unit_curve(model, b, c, x)
    return y if d is None else F.coalesce(d, F.lit(0.0)) + y


def least_squares_aic(n: Column, rss: Column, parameters: int | Column) -> Column:
    """AIC under Gaussian errors, the error variance counted as a parameter; NULL when RSS is 0."""
    known = F.when(rss > 0, rss)
    return n * (F.lit(math.log(2 * math.pi) + 1) - F.ln(n) + F.ln(known)) + F.lit(2.0) * (parameters + 1)
