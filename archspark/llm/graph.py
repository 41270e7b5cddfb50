"""Connected components of an edge table by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): the smallest node reachable, for every node with an edge.

    Each round takes the least label of a node's neighbours and then the label of its
    label; paths halve, so the rounds grow with the logarithm of the longest one. Labels
    and edges stay distributed; a round is a written table.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = step.select(F.col("node").alias("up"), F.col("comp").alias("up_comp"))
        step = step.join(up, step["comp"] == up["up"]).select("node", "was", F.least("comp", "up_comp").alias("comp"))
        step = settle(step, "cc-labels")
        labels = step.select("node", "comp")
        if step.filter("was <> comp").isEmpty():
            return labels
