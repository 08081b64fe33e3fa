"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node that can
    be reached. Each round takes the smallest label of a node's neighbours and then
    that label's own label, so that long chains shrink by halves. Labels are written
    to the shared folder in each round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = stored(step, "labels", instead_of=labels)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(step.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")), "labels", instead_of=step)
        labels = after.select("node", "label")
        labels.stored_at = after.stored_at
        if after.where("old <> label").isEmpty():
            discard(both)
            return labels
