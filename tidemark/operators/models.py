"""Comparing fitted models and reading their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import ratio
from tidemark.operators.aggregates import exact_median
from tidemark.operators.joins import join_keys
from tidemark.operators.reshape import unpivot_measures
from tidemark.operators.selection import best_rows


def model_share(fits: DataFrame, keys: list[str], score: str = "aic") -> DataFrame:
    """How often each model has the lowest known AIC of its group, in whole percent.

    The models are few, so their counts meet in one row: the fits are read once.
    """
    tally = best_rows(fits, keys, score).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    whole = tally.agg(F.sum("n").alias("total"), F.collect_list(F.struct("model", "n")).alias("models"))
    return whole.select("total", F.inline("models")).select(
        "model", "n", F.bround(ratio(F.lit(100.0) * F.col("n"), F.col("total")), 0).alias("percent"))


def median_scores(fits: DataFrame, by: list[str], score: str = "aic") -> DataFrame:
    """Exact median and number of the known AIC values."""
    return exact_median(fits, by, score, "median_aic", count="n")


def parameters_long(fits: DataFrame, keys: list[str], terms: tuple[str, ...] = ("a", "b", "c", "d")) -> DataFrame:
    """One row per fit and parameter; a parameter the model does not have is left out."""
    long = unpivot_measures(fits.select(*keys, *terms), keys, list(terms), "term", "estimate")
    return long.filter(F.col("estimate").isNotNull())


def parameter_medians(parameters: DataFrame, by: list[str]) -> DataFrame:
    return exact_median(parameters, [*by, "term"], "estimate", "median", count="n")


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 60) -> DataFrame:
    """Equal-width bins between the group's smallest and largest known value; the largest falls in the last bin."""
    known = df.filter(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    slot = F.when(F.col("__high") > F.col("__low"),
                  F.least(F.floor((F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")) * bins) + 1,
                          F.lit(bins))).otherwise(F.lit(1))
    placed = join_keys(known, ends, by).withColumn("bin", slot.cast("int"))
    counts = placed.groupBy(*by, "bin", "__low", "__high").agg(F.count(F.lit(1)).alias("n"))
    start = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("bin") - 1) / bins
    return counts.select(*by, "bin", start.alias("bin_start"), "n")


def scaled_density(df: DataFrame, by: list[str], value: str, points: int = 128, fine: int = 1024) -> DataFrame:
    """Gaussian kernel density over the group's range, scaled to a maximum of 1.

    The bandwidth is Silverman's rule of thumb from the standard deviation alone. Values are first
    counted in ``fine`` equal bins, as is usual for density curves, so the work per group is
    ``points * fine`` however many values it has.
    """
    known = df.filter(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(
        F.min(value).alias("__low"), F.max(value).alias("__high"),
        (F.lit(0.9) * F.stddev_samp(value) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("__h"),
    ).filter((F.col("__high") > F.col("__low")) & (F.col("__h") > 0))
    width = (F.col("__high") - F.col("__low")) / fine
    slot = F.least(F.floor((F.col(value) - F.col("__low")) / width), F.lit(fine - 1))
    binned = join_keys(known, ends, by).withColumn("__slot", slot).groupBy(
        *by, "__low", "__high", "__h", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    grid = binned.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("point") / (points - 1)
    centre = F.col("__low") + (F.col("__slot") + 0.5) * (F.col("__high") - F.col("__low")) / fine
    z = (at - centre) / F.col("__h")
    summed = grid.groupBy(*by, "point", at.alias("x")).agg(F.sum(F.col("__n") * F.exp(-z * z / 2)).alias("__k"))
    tops = summed.groupBy(*by).agg(F.max("__k").alias("__top"))
    return join_keys(summed, tops, by).select(*by, "point", "x", ratio(F.col("__k"), F.col("__top")).alias("scaled"))


def unsettled(fits: DataFrame) -> DataFrame:
    """Fits whose search had not settled."""
    return fits.filter(~F.col("converged"))


def invalid_score(fits: DataFrame) -> DataFrame:
    """Fits without an AIC."""
    return fits.filter(F.col("aic").isNull())


def has_score(score: Column) -> Column:
    return F.when(score.isNull(), "no").otherwise("yes")
