"""Publishing: fixed digits, fixed column order, quoted CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_digits(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def sorted_rows(df: DataFrame, keys: list[str], within: bool = False) -> DataFrame:
    """Rows in the order of ``keys``: over all files by ranges of the keys, or ``within`` each file only (no shuffle)."""
    return df.sortWithinPartitions(*keys) if within else df.orderBy(*keys)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """Quoted CSV with a header, ``NA`` for NULL. Every task writes its own file, with ``order`` a range of the keys."""
    out = df.select(*columns) if columns else df
    out = sorted_rows(out, order) if order else out
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("nullValue", "NA").csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Parquet for further work, in folders per value of ``by`` (campaign, say) so later filters skip files.

    ``order`` sorts the rows within each file, so that row groups can be skipped, too.
    """
    out = (sorted_rows(df, [*(by or []), *order], within=True) if order else df).write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def read_back(df_like: DataFrame, path: str) -> DataFrame:
    """Read a table written by ``write_csv`` under the schema of ``df_like``."""
    return df_like.sparkSession.read.schema(df_like.schema).option("header", True).option("nullValue", "NA").csv(path)


def in_published_order(df_like: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A table of ``write_csv`` read back with ``in_order``: no row sorts before the one above it, nor before an earlier file.

    Rows are compared within their file, files by their first and last rows in the order of their names.
    """
    back = df_like.sparkSession.read.schema(df_like.schema).option("header", True).option("nullValue", "NA").csv(path)
    placed = back.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                         F.monotonically_increasing_id().alias("__row"), F.struct(*keys).alias("__key"))
    above = F.lag("__key").over(Window.partitionBy("__file").orderBy("__block", "__row"))
    files = placed.groupBy("__file").agg(F.min("__key").alias("__first"), F.max("__key").alias("__last"))
    reach = F.max("__last").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    files = files.select("__file", F.coalesce(reach <= F.col("__first"), F.lit(True)).alias("__follows"))
    checked = placed.withColumn("__rising", F.coalesce(above <= F.col("__key"), F.lit(True)))
    return checked.join(files, "__file").select(*df_like.columns, (F.col("__rising") & F.col("__follows")).alias("in_order"))
