"""Connected components as DataFrames: smallest label of the neighbours, then pointer jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it reaches, of every node that ``edges`` (``a``, ``b``) mentions.

    Nodes may be of any ordered type and must not be null. A hub with a large part of all edges is combined before the
    shuffle where it is the receiver, and is a skewed join's key, which adaptive execution splits, where it is the sender.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = nearer.join(jump, nearer.via == jump["at"]).select("node", "old", F.least("via", "further").alias("label"))
        step = checkpointed(step)
        moved = not step.filter("label <> old").isEmpty()
        labels = step.select("node", "label")
        if not moved:
            return labels
