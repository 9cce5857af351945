"""Row generation: copies, edits, replications and appends, all in one pass over the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import is_true

_CHUNK = 100_000


def _edited(df: DataFrame, edits: dict[str, Column]) -> Column:
    fields = [edits[f.name].cast(f.dataType).alias(f.name) if f.name in edits else F.col(f.name) for f in df.schema]
    return F.struct(*fields)


def copy_edit(df: DataFrame, rules: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Keep every row and add, per matching rule, a copy with some columns changed."""
    variants = [_edited(df, {})] + [F.when(is_true(p), _edited(df, e)) for p, e in rules]
    return df.select(F.inline(F.filter(F.array(*variants), lambda s: s.isNotNull())))


def replace_rows(df: DataFrame, predicate: Column, edits: list[dict[str, Column]]) -> DataFrame:
    """Put one edited copy per entry of ``edits`` in the place of each matching row."""
    same = F.array(_edited(df, {}))
    new = F.array(*[_edited(df, e) for e in edits])
    return df.select(F.inline(F.when(is_true(predicate), new).otherwise(same)))


def repeat_as(df: DataFrame, column: str, values: list) -> DataFrame:
    """Every row once per value, the value put into ``column``."""
    kind = df.schema[column].dataType
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(column)).select(*df.columns)


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Every row ``times`` times; the column ``times`` is dropped.

    Two nested explodes keep each generated array short however large the count is.
    """
    whole = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / _CHUNK)))
    left = F.least(F.col(times) - F.col("__block") * _CHUNK, F.lit(_CHUNK))
    kept = [c for c in df.columns if c != times]
    blocks = df.filter(F.col(times) > 0).withColumn("__block", whole)
    return blocks.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), left))).select(*kept)


def append(*frames: DataFrame, fill: bool = False) -> DataFrame:
    """Stack frames by column name; with ``fill`` a missing column becomes NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=fill)
    return out
