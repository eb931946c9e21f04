"""Connected components by minimum labels with pointer jumping, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def component_labels(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is its component's least node.

    Each round takes the least label among a node's neighbours, then the label of
    that label. Rounds are stored, so a lost executor costs one round at most. Both
    joins have one row per node on one side: a hot node is split by adaptive execution,
    and the minima combine before they are shuffled. Only a count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    links = stored(both, folder, "links")
    labels = stored(
        links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")),
        folder,
        "labels-0",
    )
    step = 0
    while True:
        step += 1
        seen = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = seen.agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_low"))
        target = labels.select(F.col("node").alias("_low"), F.col("label").alias("_jump"))
        moved = lower.join(target, "_low").select(
            "node", F.least("_low", "_jump").alias("label"), (F.least("_low", "_jump") < F.col("label")).alias("_new")
        )
        current = stored(moved, folder, f"labels-{step}")
        if current.where("_new").isEmpty():
            return current.select("node", "label")
        labels = current.select("node", "label")
