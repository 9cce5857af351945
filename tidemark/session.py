"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the operators are written for.

    AQE does the run-time work the operators count on: it turns a shuffled join into a broadcast
    join once the *measured* size of a side allows it, and it splits hot join partitions.
    ``forceOptimizeSkewedJoin`` lets it split them even when the next aggregate must shuffle again.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def wide_parallelism(spark: SparkSession) -> int:
    """Partition count for small inputs that expand into much work.

    AQE sizes partitions by bytes, so it would fold such an input into one task. A partition count
    given by number is left alone.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` behind a shuffle on ``keys`` that all its readers in one plan reuse, so that costly work before it runs once."""
    return df.repartition(wide_parallelism(df.sparkSession), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = (sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
              or spark.conf.get("spark.checkpoint.dir", None))
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
