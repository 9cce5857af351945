"""Exact medians whose brackets miss the middle."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators.aggregates import exact_median

SCHEMA = "g string, h int, v double"


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for g in range(25):
        kind, n = g % 5, rng.choice([1, 2, 3, 50, 401])
        for _ in range(n):
            v = (rng.random(), rng.choice([0.0, 1.0, 7.0]), 10 ** rng.uniform(-200, 200), -rng.expovariate(1), 5.0)[kind]
            out.append((f"g{g}" if g else None, g % 3, v))
        out += [(f"g{g}" if g else None, g % 3, None)] * 2
    return out + [("nothing", 1, None)]


def expected(table):
    groups = {}
    for g, h, v in table:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    return {k: (statistics.median(v), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("options", [{}, {"accuracy": 2, "margin": 0.0}, {"accuracy": 2}, {"accuracy": 3, "margin": 0.1, "buckets": 2},
                                     {"margin": 0.0, "buckets": 1}])
def test_medians_are_exact_whatever_the_bracket(spark, options):
    table = rows()
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = {(r.g, r.h): (r.median, r.n) for r in exact_median(df, ["g", "h"], "v", count="n", **options).collect()}
    assert got == expected(table)


def test_forced_misses_lose_no_group(spark):
    df = spark.range(0, 40000, 1, 8).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 40009).cast("double").alias("v"))
    narrow = exact_median(df, ["g"], "v", accuracy=2, margin=0.0)
    exact = df.groupBy("g").agg(F.percentile("v", 0.5).alias("median"))
    assert sorted(narrow.collect()) == sorted(exact.collect()) and narrow.count() == 7
    sketch = {r.g: r.q for r in df.groupBy("g").agg(F.percentile_approx("v", 0.5, 2).alias("q")).collect()}
    assert any(sketch[r.g] != r.median for r in exact.collect())  # the brackets do miss


def test_groups_that_hit_are_not_read_again(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    out = exact_median(lines, ["l_returnflag"], "l_extendedprice")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet.*?PushedFilters: \[(.*?)\]", plan)
    assert len(scans) <= 2 or all("LessThanOrEqual" in s for s in scans[2:])
    assert exact_median(lines.limit(0), ["l_returnflag"], "l_extendedprice").count() == 0
