"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label): each node that a link names, with the least node it can
    reach. ``links`` has columns a and b (long, no nulls).

    Each round takes the least label among a node's neighbours and then the
    label of that label, so distances halve; every round's labels are written
    to the shared folder, and rounds end when none changed.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
                 .filter("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        nearer = stage(labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "nearer")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(nearer.join(jump, "label", "left").select(
            "node", "old", F.coalesce("far", "label").alias("label")), "labels")
        if not new.filter("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
