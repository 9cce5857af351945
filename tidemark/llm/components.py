"""Connected components of an edge table, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of ``edges`` (a, b: long).

    Each round gives every node the least label around it and then the label of that label (pointer jumping), so long
    chains shrink fast. Minima are combined before they are shuffled, and labels are written to the shared folder after each
    round. Nothing but a count of changes reaches the driver. An empty table has no components.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(MOST_ROUNDS):
        around = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
                  .withColumnRenamed("a", "node"))
        lower = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        of = lower.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        after = lower.join(of, "low").select(
            "node", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved"))
        after = cut_lineage(after)
        labels = after.select("node", "label")
        if not after.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
