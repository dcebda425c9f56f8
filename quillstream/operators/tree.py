"""Ancestors in trees of messages, as rows: pointer doubling over an edge table, for conversations of any size.

sources.conversations.chain_places() does the same inside one row, where a conversation is a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize

_KEY = ["conversation", "node"]


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(conversation, node, steps) of each start's way up to its root: steps is 0 for the start itself.

    edges(conversation, node, parent) has a row for each node, starts(conversation, node) one for each conversation. A parent that is null or no
    node ends the way, and so does a node that was on it already. Nulls as nodes or conversations are left out; so is an unknown start, and a node that stands twice
    has the smallest of its parents.

    Every round doubles how far each node looks up: joins on conversation and node, which spread a conversation's nodes over all tasks, as many
    rounds as the logarithm of the longest way. Each is written to the shared folder.
    """
    nodes = materialize(edges.where("conversation is not null and node is not null").groupBy(*_KEY).agg(F.min("parent").alias("up")))
    known = nodes.select("conversation", F.col("node").alias("up"))
    jump = materialize(nodes.where("up is not null").join(known, ["conversation", "up"], "left_semi").select(*_KEY, "up"))
    path = materialize(starts.select(*_KEY).distinct().join(nodes.select(*_KEY), _KEY, "left_semi").withColumn("steps", F.lit(0).cast("long")))
    reach, size = 1, path.count()
    while True:
        further = path.join(jump, _KEY).select("conversation", F.col("up").alias("node"), (F.col("steps") + reach).alias("steps"))
        path = materialize(path.union(further).groupBy(*_KEY).agg(F.min("steps").alias("steps")))
        grown = path.count()
        if grown == size:
            return path
        size, reach = grown, reach * 2
        onward = jump.select("conversation", F.col("node").alias("up"), F.col("up").alias("further"))
        jump = materialize(jump.join(onward, ["conversation", "up"]).select(*_KEY, F.col("further").alias("up")))
