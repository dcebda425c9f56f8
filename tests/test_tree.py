import random
import time

import pytest
from pyspark.sql import functions as F

from quillstream.operators.tree import ancestors
from quillstream.sources.conversations import chain_places


def walk(parents, start):
    out = []
    while start in parents and start not in out:
        out.append(start)
        start = parents[start]
    return out


def forest(seed, n):
    """Trees, ways to unknown nodes, loops of one and cycles."""
    rng = random.Random(seed)
    found = {}
    for c in range(n):
        size = rng.randrange(0, 30)
        parents = {f"n{i}": rng.choice([f"n{max(0, i - rng.randrange(1, 4))}", f"n{i + 1}", None, "gone"] if rng.random() < 0.25 else [f"n{i - 1}"]) for i in range(size)}
        found[f"c{c}"] = parents, f"n{rng.randrange(0, 32)}"
    return found


def test_rows_and_arrays_agree_with_the_walk(spark):
    trees = forest(1, 60)
    want = {c: walk(*t) for c, t in trees.items()}
    edges = spark.createDataFrame([(c, k, p) for c, (ps, _) in trees.items() for k, p in ps.items()], "conversation string, node string, parent string")
    starts = spark.createDataFrame([(c, s) for c, (_, s) in trees.items()], "conversation string, node string")
    got = {}
    for r in sorted(ancestors(edges, starts).collect(), key=lambda r: r.steps):
        got.setdefault(r.conversation, []).append(r.node)
    assert got == {c: w for c, w in want.items() if w}
    rows = spark.createDataFrame([(c, list(ps), list(ps.values()), s) for c, (ps, s) in trees.items()], "c string, nodes array<string>, parents array<string>, start string")
    found = rows.select("c", F.transform(chain_places(F.col("nodes"), F.col("parents"), F.col("start")), lambda p: F.get("nodes", p)).alias("path")).collect()
    assert {r.c: r.path for r in found} == want


def test_one_long_conversation_is_spread_over_tasks(spark):
    """A third of all nodes in one way: few rounds, and no task joins more than its share."""
    n = 30_000
    edges = spark.range(3 * n).select(
        F.when(F.col("id") < n, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") / 10).cast("long").cast("string"))).alias("conversation"), F.col("id").alias("node"),
        F.when((F.col("id") > 0) & ((F.col("id") < n) | (F.col("id") % 10 > 0)), F.col("id") - 1).alias("parent"),
    )
    began = time.time()
    found = ancestors(edges, edges.groupBy("conversation").agg(F.max("node").alias("node")))
    assert found.count() == 3 * n and found.where("conversation = 'hot'").agg(F.max("steps")).first()[0] == n - 1
    assert time.time() - began < 120
    sizes = [r["count"] for r in edges.where("conversation = 'hot'").repartition(4, "conversation", "node").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * n


@pytest.mark.parametrize("n", [8_000])
def test_a_long_way_inside_one_row(spark, n):
    rows = spark.createDataFrame([([f"n{i}" for i in range(n)], [None, *(f"n{i}" for i in range(n - 1))], f"n{n - 1}")], "nodes array<string>, parents array<string>, start string")
    began = time.time()
    assert rows.select(chain_places(F.col("nodes"), F.col("parents"), F.col("start")).alias("p")).first().p == list(range(n - 1, -1, -1))
    assert time.time() - began < 30


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conversation string, node string, parent string")
    assert ancestors(empty, empty.select("conversation", "node")).count() == 0
