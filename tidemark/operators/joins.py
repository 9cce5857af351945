"""Joins whose keys match NULL to NULL.

No side is ever hinted as broadcast: the planner broadcasts below ``autoBroadcastJoinThreshold``
from file or measured shuffle sizes, and AQE splits hot partitions of the other joins.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RIGHT = "__right_"


def _on(keys: list[str]) -> Column:
    return reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(_RIGHT + k)) for k in keys])


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A table of rows given in code. Unlike one of Python tuples its size is known to the planner, so a join with it needs no
    shuffle as long as it stays below ``autoBroadcastJoinThreshold``, and shuffles beyond that.
    """
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on shared names; every key appears once in the result."""
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys)
    others = [c for c in right.columns if c not in keys]
    clash = set(others) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    renamed = right.select(*[F.col(k).alias(_RIGHT + k) for k in keys], *others)
    joined = left.join(renamed, _on(keys), how)
    if how in ("left_semi", "left_anti"):
        return joined
    rest = [c for c in left.columns if c not in keys]
    full = how in ("full", "full_outer", "outer", "right")
    shown = [F.coalesce(F.col(k), F.col(_RIGHT + k)).alias(k) if full else F.col(k) for k in keys]
    return joined.select(*shown, *rest, *others)


def anti_identical(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of ``df`` equal to no row of ``removed`` in the columns both have.

    Copies of a kept row all stay. When ``removed`` is just ``df`` under a predicate, use
    ``delete_where`` instead: the result is the same and no join is needed.
    """
    shared = [c for c in df.columns if c in removed.columns]
    return join_keys(df, removed, shared, "left_anti")


def anti_rules(df: DataFrame, rules: DataFrame, keys: list[str], optional: list[str]) -> DataFrame:
    """Rows matched by no rule; in the ``optional`` columns of a rule NULL stands for any value.

    ``keys`` are matched by hash, so a rule costs only the rows that share its keys.
    """
    renamed = rules.select(*[F.col(c).alias(_RIGHT + c) for c in keys + optional]).distinct()
    condition = _on(keys)
    for c in optional:
        condition &= F.col(_RIGHT + c).isNull() | (F.col(_RIGHT + c) == F.col(c))
    return df.join(renamed, condition, "left_anti")


def flag_matches(df: DataFrame, flagged: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``yes`` on rows whose keys occur in ``flagged``, ``no`` on the others."""
    marks = flagged.select(*keys).distinct().withColumn(name, F.lit("yes"))
    return join_keys(df, marks, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit("no")))
