"""Group summaries that need more than one aggregate call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import mean, ratio
from tidemark.operators.joins import join_keys


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: Column, name: str,
                  strict: bool = False) -> DataFrame:
    """Mean per ``inner`` group, then the unweighted mean of those per ``outer`` group."""
    return (
        df.groupBy(*inner).agg(mean(value, strict).alias("__inner"))
        .groupBy(*outer).agg(mean(F.col("__inner"), strict).alias(name))
    )


def percent_share(df: DataFrame, keys: list[str], count: str = "n", percent: str = "percent") -> DataFrame:
    """Rows per group and their share of all rows in whole percent, halves rounded to even."""
    tally = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    total = tally.agg(F.sum(count)).scalar()
    return tally.withColumn(percent, F.bround(ratio(F.lit(100.0) * F.col(count), total), 0))


def _running(over: list[str], by: str) -> Column:
    frame = Window.partitionBy(*over).orderBy(F.col(by).asc_nulls_first())
    return F.sum("__m").over(frame.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _narrowed(rows: DataFrame, ranges: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``ranges`` (a rank looked for, the ends of the values it lies in, the rows before them) cut to one bucket of values."""
    inside = join_keys(rows, ranges, keys).filter(F.col("__v").between(F.col("__least"), F.col("__most")))
    place = F.floor((F.col("__v") - F.col("__least")) / F.nullif(F.col("__most") - F.col("__least"), F.lit(0.0)) * buckets)
    counted = inside.withColumn("__bucket", F.least(F.coalesce(place, F.lit(0)), F.lit(buckets - 1))).groupBy(
        *keys, "__rank", "__n", "__before", "__bucket").agg(
        F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    placed = counted.withColumn("__to", F.col("__before") + _running([*keys, "__rank"], "__bucket"))
    start = F.col("__to") - F.col("__m")
    return placed.filter((start < F.col("__rank")) & (F.col("__rank") <= F.col("__to"))).select(
        *keys, "__rank", "__n", start.alias("__before"), "__least", "__most")


def _ranked_again(known: DataFrame, missed: DataFrame, keys: list[str], buckets: int, rounds: int = 2) -> DataFrame:
    """The middle values of groups whose bracket misses them, by exact counts over ever narrower ranges of values.

    Where no group is missed the bounds below are NULL, no row group of the input passes them, and nothing is shuffled.
    """
    least, most = missed.agg(F.min("__least")).scalar(), missed.agg(F.max("__most")).scalar()
    rows = known.filter((F.col("__v") >= least) & (F.col("__v") <= most))
    ranges = missed.select(*keys, "__n", "__least", "__most", F.lit(0).cast("long").alias("__before"), F.explode(
        F.array_distinct(F.array("__low", "__high"))).alias("__rank"))
    for _ in range(rounds):
        ranges = _narrowed(rows, ranges, keys, buckets)
    values = join_keys(rows, ranges, keys).filter(F.col("__v").between(F.col("__least"), F.col("__most"))).groupBy(
        *keys, "__rank", "__n", "__before", "__v").agg(F.count(F.lit(1)).alias("__m"))
    to = F.col("__before") + _running([*keys, "__rank"], "__v")
    found = values.withColumn("__to", to).filter(
        (F.col("__to") - F.col("__m") < F.col("__rank")) & (F.col("__rank") <= F.col("__to")))
    return found.groupBy(*keys, "__n").agg(F.min("__v").alias("__lower"), F.max("__v").alias("__upper"))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", count: str | None = None,
                 accuracy: int = 10000, buckets: int = 4096, margin: float | None = None) -> DataFrame:
    """Exact median per group without holding a group's values anywhere.

    A mergeable quantile sketch per group brackets the middle by ``margin`` to each side (four times its rank error of
    ``1/accuracy``, if not given). The rows below the bracket are counted, those inside it (a few parts in ``accuracy`` of
    the group) per distinct value. The bracket is then cut into equal ``buckets``; running counts over at most that many
    rows tell which of them hold the middle ranks, and only those are ranked value by value.

    The counts are exact, so they show whether a bracket holds both middle ranks. Groups where it does not are ranked again
    over all their values, cut to one of ``buckets`` equal ranges twice before values are told apart.
    """
    known = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    margin = 4.0 / accuracy if margin is None else margin
    brackets = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"),
        F.percentile_approx("__v", [max(0.5 - margin, 0.0), min(0.5 + margin, 1.0)], accuracy).alias("__q"),
    )
    low_end, high_end = F.col("__q")[0], F.col("__q")[1]
    place = F.floor((F.col("__v") - low_end) / F.nullif(high_end - low_end, F.lit(0.0)) * buckets)
    slots = (
        join_keys(known, brackets, keys)
        .filter(F.col("__v") <= high_end)
        .withColumn("__slot", F.when(F.col("__v") >= low_end, F.col("__v")))
        .withColumn("__bucket", F.when(F.col("__slot").isNull(), -1).otherwise(F.coalesce(place, F.lit(0))))
        .groupBy(*keys, "__n", "__bucket", "__slot").agg(F.count(F.lit(1)).alias("__m"))
    )
    low, high = F.floor((F.col("__n") + 1) / 2), F.ceil((F.col("__n") + 1) / 2)
    per_bucket = slots.groupBy(*keys, "__n", "__bucket").agg(F.sum("__m").alias("__m"))
    placed = per_bucket.withColumn("__to", _running(keys, "__bucket")).withColumn("__before", F.col("__to") - F.col("__m"))
    middle = placed.filter((F.col("__before") < high) & (low <= F.col("__to"))).select(*keys, "__bucket", "__before")
    ranked = join_keys(slots, middle, [*keys, "__bucket"]).withColumn(
        "__hi", F.col("__before") + _running([*keys, "__bucket"], "__slot")).withColumn(
        "__lo", F.col("__hi") - F.col("__m") + 1)
    at_low = F.when(low.between(F.col("__lo"), F.col("__hi")), F.col("__slot"))
    at_high = F.when(high.between(F.col("__lo"), F.col("__hi")), F.col("__slot"))
    held = ranked.groupBy(*keys, "__n").agg(F.max(at_low).alias("__lower"), F.max(at_high).alias("__upper")).filter(
        F.col("__lower").isNotNull() & F.col("__upper").isNotNull())
    missed = join_keys(brackets, held, keys, "left_anti").select(
        *keys, "__n", "__least", "__most", low.alias("__low"), high.alias("__high"))
    both = held.unionByName(_ranked_again(known, missed, keys, buckets))
    out = [((F.col("__lower") + F.col("__upper")) / 2).alias(name)]
    return both.select(*keys, *out, *([F.col("__n").alias(count)] if count else []))


def endpoint_median(df: DataFrame, keys: list[str], day: str, last: bool = False, name: str = "median") -> DataFrame:
    """Median over all groups of their first (or last) day; tied rows count each.

    The final aggregate holds one entry per distinct day, which the calendar bounds.
    """
    ends = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("__k")).groupBy(*keys).agg(
        (F.max if last else F.min)(day).alias("__end"), (F.max_by if last else F.min_by)("__k", day).alias("__k"))
    weights = ends.filter(F.col("__end").isNotNull()).groupBy("__end").agg(F.sum("__k").alias("__w"))
    return weights.agg(F.percentile("__end", 0.5, F.col("__w")).alias(name))


def endpoint_max(df: DataFrame, keys: list[str], order: str, value: str, last: bool = True,
                 name: str = "bound") -> DataFrame:
    """Largest value seen at the last (or first) ``order`` position of any group, ties included."""
    at_end = df.groupBy(*keys, order).agg(F.max(value).alias("__v"))
    pick = F.max_by if last else F.min_by
    return at_end.groupBy(*keys).agg(pick("__v", order).alias("__v")).agg(F.max("__v").alias(name))
