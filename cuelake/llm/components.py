"""Connected components of a table of edges, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of edges(a, b).

    Each round takes the least label among a node's neighbours, then the label of
    that label, so a chain of n nodes needs about log n rounds. Labels are written
    to the shared folder in each round; nothing but a count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "edges")
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = least.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        now = stored(jumped.select("node", F.least("label", "next").alias("label"), (F.least("label", "next") != F.col("old")).alias("moved")), "labels")
        drop_stored(labels)
        labels = now.select("node", "label")
        labels.stored_at = now.stored_at
        if now.where("moved").isEmpty():
            drop_stored(both)
            return labels.union(alone.join(labels, "node", "left_anti"))
