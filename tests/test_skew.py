"""A third or more of all rows under one key."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, selection
from tidemark.session import cut_lineage, shared_folder

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def shuffled_joins(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_table(spark):
    """60,000 rows, two thirds of them of one unnamed key."""
    return spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 97).alias("g"),
        F.date_add(F.lit("2010-01-01").cast("date"), (F.col("id") % 360).cast("int")).alias("date"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"))


def test_hot_join_partitions_are_split(shuffled_joins):
    df = hot_table(shuffled_joins)
    for out, expected in (
        (selection.attach_bounds(df, ["g"], "date", "first", "last"), 60000),
        (selection.gate_rows(df, ["g"], min_rows=300), 40000),
        (joins.join_keys(df, df.filter("g < 5").select("g"), ["g"], "left_anti"), None),
    ):
        n = out.write.format("noop").mode("overwrite").save() or out.count()
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan.split("== Initial Plan ==")[0]
        assert len(rows) == n and (expected is None or n == expected)


def test_hot_key_spreads_over_its_days(shuffled_joins):
    """Rows at a bound are matched by key and day, so a hot key does not meet in one partition."""
    out = selection.rows_at_bound(hot_table(shuffled_joins), ["g"], "date")
    rows = out.collect()
    firsts = {}
    for r in hot_table(shuffled_joins).select("g", "date").distinct().collect():
        firsts[r.g] = min(firsts.get(r.g, r.date), r.date)
    assert {(r.g, r.date) for r in rows} == set(firsts.items())


def test_checkpoints_go_to_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named.rstrip("/").split("/")[-1] in shared_folder(spark)
    df = cut_lineage(spark.range(10))
    assert df.count() == 10 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
