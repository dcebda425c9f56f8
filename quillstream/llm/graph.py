"""Connected components of an edge table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges(a, b): component is the smallest id reachable.

    An id's edges to smaller ones become one edge to the least of these, and edges from it to the others; as many ids share
    theirs, few edges are left. Each round then takes the least label among neighbours, then the label's own label (pointer
    jumping), so stars end after two rounds and paths after about the logarithm of their length. Every round is
    written to the shared folder. Repeated edges and loops do no harm; no edges give no rows.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    least = F.min("a").over(Window.partitionBy("b"))
    edges = edges.withColumn("least", least).select(F.col("least").alias("a"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b"))
    edges = stash(edges.distinct(), "stars")
    both = edges.union(edges.select("b", "a"))
    labels = stash(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        hop = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "least").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("above"))
        step = stash(hop.join(up, "next").select("id", "old", F.least("next", "above").alias("component")), "labels")
        labels = step.select("id", "component")
        if step.where("old <> component").isEmpty():
            return labels
