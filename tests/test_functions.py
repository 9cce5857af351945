import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import curves, derive
from tidemark.functions.nulls import composite_key, delete_where, distinct_count_with_null, mean, ratio


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_null_predicate_keeps_the_row(spark):
    df = spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "id int, bag string")
    assert {r.id for r in delete_where(df, F.col("bag") != "1").collect()} == {1, 3}


def test_keys_and_counts_with_nulls(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", None), ("b", "x", 3.0)], "g string, k string, v double")
    keys = {r.k for r in df.select(composite_key("g", "k").alias("k")).collect()}
    assert keys == {"a_NA", "a_x", "b_x"}
    got = {r.g: (r.n, r.strict, r.known) for r in df.groupBy("g").agg(
        distinct_count_with_null("k").alias("n"), mean(F.col("v"), True).alias("strict"), mean(F.col("v")).alias("known")
    ).collect()}
    assert got == {"a": (2, None, 1.0), "b": (1, 3.0, 3.0)}


def test_zero_over_zero_is_null(spark):
    assert value(spark, ratio(F.lit(0.0), F.lit(0.0))) is None


@pytest.mark.parametrize("day, offset", [("2010-01-01", 0), ("2009-12-31", -1), ("2010-12-31", 364), ("2011-01-01", 365)])
def test_day_offset(spark, day, offset):
    assert value(spark, derive.day_offset(F.lit(day).cast("date"), F.lit(2010))) == offset


@pytest.mark.parametrize("text, day", [("05/03/2010", dt.date(2010, 3, 5)), ("31/02/2010", None), ("", None)])
def test_parse_date(spark, text, day):
    assert value(spark, derive.parse_date(F.lit(text))) == day


@pytest.mark.parametrize("text, year", [("93", 1993), ("99", 1999), ("00", 2000), ("18", 2018), ("", None), ("xx", None)])
def test_century(spark, text, year):
    assert value(spark, derive.century(F.lit(text))) == year


def test_span_is_inclusive(spark):
    assert value(spark, derive.span(F.lit("2009_N0_WILD_2n_AR"), 6, 18)) == "N0_WILD_2n_AR"
    assert value(spark, derive.span(F.lit("RE00_GJ_CN99_AR"), 14, 15)) == "AR"


def test_last_match_wins(spark):
    both = derive.last_match(F.lit("a"), (F.lit(True), "b"), (F.lit(True), "c"), (F.lit(None).cast("boolean"), "d"))
    assert value(spark, both) == "c"


def test_curves(spark):
    x = F.lit(150.0)
    assert value(spark, curves.curve(F.lit("Logistic"), F.lit(2.0), F.lit(0.1), F.lit(150.0), x, F.lit(1.0))) == 2.0
    gompertz = value(spark, curves.curve(F.lit("Gompertz"), F.lit(1.0), F.lit(0.1), F.lit(150.0), x))
    assert gompertz == pytest.approx(math.exp(-1))


def test_aic(spark):
    n, rss, k = 12, 3.5, 3
    expected = n * (math.log(2 * math.pi) + 1 - math.log(n) + math.log(rss)) + 2 * (k + 1)
    assert value(spark, curves.least_squares_aic(F.lit(float(n)), F.lit(rss), k)) == pytest.approx(expected)
    assert value(spark, curves.least_squares_aic(F.lit(float(n)), F.lit(0.0), k)) is None
