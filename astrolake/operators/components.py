"""Connected components by min-label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.session import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node with the smallest node id of its component.

    ``nodes(id)``, ``edges(a, b)``.  Each round takes the smallest label among neighbours and then
    jumps to the label's own label, so long chains halve per round; every round is checkpointed.
    Labels only fall, so the loop ends by itself at any size.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("nl", F.col("label"))).alias("label"))
        step = cut(step)
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", F.col("label"))).alias("label")))
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")
