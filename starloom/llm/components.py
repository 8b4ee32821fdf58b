"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is
    its smallest node.

    Every round takes the smallest label among a node's neighbours, then jumps
    to the label of that label, so that rounds grow with the logarithm of the
    longest shortest path.  Rounds are written tables (a checkpoint would carry
    the planner's constraints from round to round, and planning them grows with the
    rounds); a round's table goes when the next one is written.  A node with very
    many edges costs one row per task in the aggregation.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        lowered = materialise(labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("low")), "lowered")
        parent = lowered.select(F.col("node").alias("low"), F.col("low").alias("parent"))
        jumped = materialise(lowered.join(parent, "low").select(
            "node", F.least("low", "parent").alias("component"), (F.least("low", "parent") < F.col("component")).alias("changed")), "labels")
        discard(labels, lowered)
        labels = jumped.select("node", "component")
        if jumped.where("changed").isEmpty():
            discard(both)
            return labels
