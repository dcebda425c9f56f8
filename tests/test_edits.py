import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillstream.functions.offsets import origins, raw_ranges
from quillstream.functions.text import normalize
from quillstream.operators import corrections
from quillstream.plans.edits import apply_changes

OPS = "array<struct<start:int,end:int,text:string>>"


def test_changes_are_merged_into_the_edits(spark):
    old = json.dumps({"patches": {"P1": {"ops": [{"start": 0, "end": 1, "text": "x"}]}, "P2": {"ops": []}}, "patchMetadata": {"P1": {"a": 1}, "P9": {"b": 2}}, "skip": ["P3", "gone", " "]})
    rows = spark.createDataFrame([("a", old, ["P1", "P2", "P3"]), ("b", None, ["P1"]), ("c", old, [])], "path string, edits string, known array<string>")
    new = [{"start": 1, "end": 2, "text": "y"}]
    changes = spark.createDataFrame([("a", "P1", [], None, True), ("a", "P2", new, '{"z":1}', None), ("a", "P3", None, None, False), ("b", "P1", new, None, None)], f"path string, id string, ops {OPS}, metadata string, skip boolean")
    out = {r.path: r.edits and json.loads(r.edits) for r in apply_changes(rows, changes).collect()}
    assert out["a"] == {"patches": {"P2": {"ops": new}}, "patchMetadata": {"P2": {"z": 1}}, "skip": ["P1"]}
    assert out["b"] == {"patches": {"P1": {"ops": new}}} and out["c"] == json.loads(old)
    back = apply_changes(apply_changes(rows, changes), spark.createDataFrame([("b", "P1", [], None, None)], f"path string, id string, ops {OPS}, metadata string, skip boolean"))
    assert {r.path: r.edits for r in back.collect()}["b"] is None


@pytest.mark.parametrize("raw", ["aP1 - x\r\nb P2a– y\\[z\\]", "", "P1 - a", "\r\r\n", "xP1-P2-yP3 -", " P1 - 😀P2 - z"])
def test_every_normalized_character_comes_from_its_origin(spark, raw):
    normal = spark.createDataFrame([(raw,)], "t string").select(normalize(F.col("t"))).first()[0]
    places = origins(raw)
    assert len(places) == len(normal) and places == sorted(places)
    assert all(raw[p] == c or c == "\n" or (c == "[" and raw[p] == "[") for c, p in zip(normal, places))


def test_raw_ranges(spark):
    rows = spark.createDataFrame([("helloP1 - a\r\nb", [6, 11], [8, 12]), (None, [], [])], "t string, a array<int>, b array<int>")
    out = [r.x for r in rows.select(raw_ranges("t", "a", "b").alias("x")).collect()]
    assert [tuple(r) for r in out[0]] == [(5, 7), (10, 11)] and out[1] is None


def test_requests_and_replies(spark):
    rows = spark.createDataFrame([("f", "P2", "b", ["x"]), ("f", "P1", "a", []), ("g", "P3", "c", [])], "path string, id string, translation string, hints array<string>")
    made = {r.path: r.request for r in corrections.request(rows, " Fix these. ").collect()}
    assert made["f"] == 'Fix these.\n{"excerpts":[{"id":"P1","text":"a","hints":[]},{"id":"P2","text":"b","hints":["x"]}]}' and "results" in corrections.reply_schema()["properties"]
    replies = lambda *ids: spark.createDataFrame([(n, i, "m", "r") for n, i in enumerate(ids)], "pos int, id string, match string, replacement string")
    assert {r.path for r in corrections.resolve(replies("P1", "P3"), rows).collect()} == {"f", "g"}
    for bad, table in ((replies("P8"), rows), (replies("P1"), rows.union(rows.withColumn("path", F.lit("h"))))):
        with pytest.raises(PySparkException):
            corrections.resolve(bad, table).collect()
