import time
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.functions import arrays as A
from quillstream.functions import text as T
from quillstream.operators import alignment

names = st.lists(st.sampled_from(["a", "b", "c", "dd", "é", "", None]), max_size=9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(names, names), min_size=1, max_size=40))
def test_searches_against_lists(spark, pairs):
    df = spark.createDataFrame([(i, v, o) for i, (v, o) in enumerate(pairs)], "i int, v array<string>, o array<string>").withColumn("x", A.index(F.col("o")))
    got = df.select(
        "v", "o", F.transform("v", lambda k: A.find(F.col("x"), k)).alias("first"), F.transform("v", lambda k: A.find(F.col("x"), k, True)).alias("last"), F.transform("v", lambda k: A.count(F.col("x"), k)).alias("n"),
        F.transform("v", lambda k: A.places(F.col("x"), k)).alias("places"), A.among(F.col("v"), F.col("o")).alias("yes"), A.among(F.col("v"), F.col("o"), False).alias("no"),
        A.running_sums(F.transform("v", lambda k: F.coalesce(F.length(k), F.lit(7)))).alias("sums"),
    ).collect()
    for r in got:
        where = lambda k: [i for i, x in enumerate(r.o) if x == k and k is not None]  # noqa: B023, E731
        assert r.first == [next(iter(where(k)), None) for k in r.v] and r.last == [next(reversed(where(k)), None) for k in r.v]
        assert r.n == [len(where(k)) for k in r.v] and r.places == [where(k) for k in r.v]
        assert r.yes == [k for k in r.v if k is not None and k in r.o] and r.no == [k for k in r.v if k is not None and k not in r.o]
        sizes = [7 if k is None else len(k) for k in r.v]
        assert r.sums == [sum(sizes[: i + 1]) for i in range(len(sizes))]


def test_nulls_and_empty_arrays(spark):
    r = spark.range(1).select(A.find(A.index(F.array()), F.lit("x")).alias("a"), A.running_sums(F.expr("cast(array() as array<int>)")).alias("b"), A.among(F.expr("cast(null as array<string>)"), F.array(F.lit("x"))).alias("c")).first()
    assert r.a is None and r.b == [] and r.c is None


def test_fifty_thousand_segments_pass_in_seconds(spark):
    n = 50_000
    ids = [f"P{i}" for i in range(n)]
    text = "\n".join(f"{x} - text of {x}" for x in ids[: n - 100] + ids[:50])
    df = spark.createDataFrame([(text, ids)], "t string, source array<string>").withColumn("n", T.normalize(F.col("t"))).withColumn("s", T.segments(F.col("n")))
    df = df.withColumn("got", F.transform("s", lambda s: s["id"]))
    began = time.time()
    r = df.select(
        F.size("s").alias("n"), F.get("s", F.lit(n - 100)).alias("one"), F.size(alignment.duplicate_ids(F.col("got"))).alias("twice"), F.size(alignment.missing_ids(F.col("source"), F.col("got"))).alias("gone"),
        F.size(alignment.invented_ids(F.col("got"), F.col("source"))).alias("made"), F.size(T.segment_map(F.col("s"))).alias("map"), alignment.exact_block(F.col("source"), F.slice("got", 1000, 2000)).alias("block"),
    ).first()
    assert time.time() - began < 40
    assert (r.n, r.twice, r.gone, r.made, r.map, r.block) == (n - 50, 50, 100, 100, n - 100, 999)
    assert r.one.id == "P0" and text[r.one.start : r.one.end] == "text of P0" and text[r.one.head :].startswith("P0 - ") and r.one.pos == n - 100


def test_labels_by_count(spark):
    rows = spark.createDataFrame([("Ann: a\nBob: b\nAnn: c\nCy: d\nBob: e\nBob: f",)], "t string").select(T.speaker_labels(F.col("t")).alias("x")).first()
    assert rows.x == ["Ann", "Bob"] == [k for k, v in Counter(["Ann", "Bob", "Ann", "Cy", "Bob", "Bob"]).items() if v > 1]
