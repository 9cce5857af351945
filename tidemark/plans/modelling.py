"""Clean indicator table to fitted curves and daily predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.curves import GOMPERTZ, LOGISTIC
from tidemark.functions.nulls import ratio
from tidemark.operators.fit import Box, Spec, fit_series
from tidemark.operators.joins import join_keys
from tidemark.operators.predict import publish_pairs, side_by_side
from tidemark.operators.selection import best_rows

# Parameter boxes per age class and measure.
BOXES = {
    ("N0", "mass"): Box(a=(0, 70), b=(0, 0.2), c=(0, 365)),
    ("N0", "mortality"): Box(a=(0, 1), b=(0, 1), c=(0, 365)),
    ("J1", "mass"): Box(a=(0, 86), b=(0, 0.2), c=(0, 365), d=(0, 69)),
    ("J1", "mortality"): Box(a=(0, 1), b=(0, 0.2), c=(0, 365)),
}
WINNERS = {"mass": LOGISTIC, "mortality": GOMPERTZ}  # the published choice
# The measures' columns and the published ones.
MEASURES = {"mass": "mean_mass", "mortality": "mean_CM"}
GROUP = ["site", "campaign"]
PREDICTED_COLUMNS = ["num", "site", "name", "zone_en", "lat", "long", "campaign", "class_age", "DOY", "CM_pred",
                     "mass_pred"]


def measured(clean: DataFrame) -> DataFrame:
    """Observations of both measures, one row each (``measure``, ``y``), rows with any missing column dropped."""
    kept = clean.drop("num", "name", "zone_en", "lat", "long")
    others = [c for c in kept.columns if c not in MEASURES.values()]
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("y")) for m, c in MEASURES.items()])
    return kept.dropna("any", subset=others).select(*others, F.inline(rows)).dropna("any", subset=["y"])


def fit_all(clean: DataFrame, rounds: int = 5, prove: bool = False) -> DataFrame:
    """All models of all groups, classes and measures in one table, from one read and one search."""
    specs = {f"{class_age} {measure}": Spec(box) for (class_age, measure), box in BOXES.items()}
    named = measured(clean).withColumn("series", F.concat_ws(" ", "class_age", "measure"))
    fits = fit_series(named, [*GROUP, "class_age", "measure"], "series", "DOY", "y", specs, rounds=rounds, prove=prove)
    return fits.drop("series")


def selection_table(fits: DataFrame) -> DataFrame:
    """How often each model has the lowest AIC, in percent within its class and measure."""
    pair = ["class_age", "measure"]
    tally = best_rows(fits, [*pair, *GROUP], "aic").groupBy(*pair, "model").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*pair))  # one row per model
    return tally.withColumn("percent", F.bround(ratio(F.lit(100.0) * F.col("n"), total), 0))


def winning_models(selection: DataFrame) -> DataFrame:
    """The most frequent best model per class and measure; a tie goes to the first name."""
    order = F.struct(F.col("n").alias("n"), (F.col("model") == GOMPERTZ).alias("first"))
    return selection.groupBy("class_age", "measure").agg(F.max_by("model", order).alias("model"))


def predicted_table(fits: DataFrame, sites: DataFrame, winners: dict[str, str] | None = None) -> DataFrame:
    """Daily predictions of one model per measure: the given one, or the winner per class and measure.

    Without ``winners`` the fits are read twice; write or checkpoint them first.
    """
    if winners is None:
        best = join_keys(fits, winning_models(selection_table(fits)), ["class_age", "measure", "model"], "left_semi")
    else:
        best = fits.filter(F.element_at(F.create_map(*[F.lit(v) for kv in winners.items() for v in kv]),
                                        F.col("measure")) == F.col("model"))

    pairs = side_by_side(best, ["site", "campaign", "class_age"], "measure", ["mortality", "mass"])
    table = publish_pairs(pairs, sites.drop("zone_fr"), ["site", "campaign", "class_age"], "site", "mortality", "mass")
    return table.select(*PREDICTED_COLUMNS)
