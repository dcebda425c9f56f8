from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.operators import corrections as C
from quillstream.operators import patches as P


def run(spark, column, **values):
    return spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items())).select(column.alias("x")).first().x


def ops(*rows):
    return [{"start": a, "end": b, "text": t} for a, b, t in rows], P.OPS


def patched(spark, text, *rows):
    return run(spark, P.apply_patch(F.col("t"), F.col("o")), t=(text, "string"), o=ops(*rows))


def test_apply(spark):
    assert patched(spark, "abcdef", (4, 5, "X"), (0, 1, "")) == "bcdXf" and patched(spark, "ab", (1, 1, "x"), (1, 1, "y")) == "axyb"
    assert patched(spark, "abc", (0, 2, "x"), (1, 3, "y")) is None and patched(spark, "abc", (2, 9, "x")) is None and patched(spark, "abc", (2, 1, "x")) is None and patched(spark, "abc") is None
    assert patched(spark, "😀bc", (1, 2, "X")) == "😀Xc"


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab c", max_size=30), st.text("ab c", max_size=30))
def test_edits_lead_from_one_text_to_the_other(a, b):
    out, at = "", 0
    for o in P.edits(a, b):
        assert o["start"] >= at
        out += a[at : o["start"]] + o["text"]
        at = o["end"]
    assert out + a[at:] == b


def test_create_and_collapse(spark):
    made = lambda a, b: [(o["start"], o["end"], o["text"]) for o in P.edits(a, b)]
    assert made("same", "same") == [] and len(made("one two three four five six seven", "oXe two thXee four five siX seven")) == 3
    assert len(made("abc def ghi jkl", "xbc yef zhi wkl")) == 1  # four edits that change most of it
    rows = spark.createDataFrame([("a b", "a c"), ("x", "x"), (None, "y")], "a string, b string").select(P.create_patch("a", "b").alias("p")).collect()
    assert rows[0].p[0].text == "c" and rows[1].p is None and rows[2].p is None


def test_highlights(spark):
    ranges = run(spark, P.highlight_ranges(F.col("o")), o=ops((9, 10, "XY"), (0, 3, ""), (5, 5, "Z")))
    assert [tuple(r) for r in ranges] == [(2, 3), (7, 9)]
    kind = "array<struct<start:int,end:int,title:string>>"
    merge = lambda text, *h: [tuple(r) for r in run(spark, P.merge_highlights(F.col("t"), F.col("h")), t=(text, "string"), h=(list(h), kind))]
    assert merge("estimated  meaning", (0, 9, None), (11, 18, None)) == [(0, 18, None)]
    assert merge("abcdef", (0, 2, "t"), (2, 4, None)) == [(0, 2, "t"), (2, 4, None)] and merge("ab\ncd", (0, 2, None), (3, 5, None)) == [(0, 2, None), (3, 5, None)]


def test_unified_diffs():
    text = "one\ntwo\nthree"
    assert P.apply_unified(text, "--- a\n+++ b\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three\n") == "one\nTWO\nthree"
    assert P.apply_unified(text, "@@ -1,1 +1,1 @@\n-zero\n+x\n") is None and P.apply_unified(text, "no diff") is None


def test_hunks_go_to_the_nearest_place_where_they_fit():
    text = "a\nb\nc\na\nb\nc\na\nb\nc"
    hunk = "@@ -{},2 +1,2 @@\n a\n-b\n+B\n"
    at = lambda line: [k for k, x in enumerate((P.apply_unified(text, hunk.format(line)) or "").split("\n")) if x == "B"]
    assert [at(n) for n in (1, 2, 3, 4, 5, 6, 7, 99)] == [[1], [1], [4], [4], [4], [7], [7], [7]]
    # as near before as behind: the later one
    assert P.apply_unified("x\no\nx", "@@ -2 +2 @@\n-x\n+y") == "x\no\ny"
    # a second hunk moves as the first one did, and never before it
    two = "@@ -1 +1 @@\n-c\n+C\n@@ -2 +2 @@\n-a\n+A\n"
    assert P.apply_unified(text, two) == "a\nb\nC\nA\nb\nc\na\nb\nc"
    assert P.apply_unified("a\nb", "@@ -1 +1 @@\n-b\n+B\n@@ -1 +1 @@\n-a\n+A\n") is None


def test_hunks_that_add_alone_ends_of_lines_and_malformed_diffs():
    assert P.apply_unified("a\nb", "@@ -1,0 +2 @@\n+x\n") == "a\nx\nb" and P.apply_unified("a\nb", "@@ -0,0 +1 @@\n+x\n") == "x\na\nb"
    assert P.apply_unified("a\nb\n", "@@ -2 +2 @@\n-b\n+c\n\\ No newline at end of file") == "a\nc"
    assert P.apply_unified("a\nb", "@@ -2 +2 @@\n-b\n\\ No newline at end of file\n+c\n") == "a\nc\n"
    assert P.apply_unified("a\nb", "@@ -2 +2 @@\n-b\n\\ No newline at end of file\n+c\n\\ No newline at end of file") == "a\nc"
    assert P.apply_unified("a\nb\n", "@@ -2 +2 @@\n-b\n\\ No newline at end of file\n+c\n\\ No newline at end of file") is None
    assert P.apply_unified("a\nb", "@@ -1,2 +1,2 @@\r\n a\r\n-b\r\n+c\r\n") == "a\nc"
    assert P.apply_unified("a\nb", "@@ -1,2 +1,1 @@\n-a\n") is None and P.apply_unified("a\nb", "@@ -1,2 +1,2 @@\n a\n?b\n") is None
    assert P.apply_unified("a\n\nb", "@@ -1,3 +1,3 @@\n-a\n+A\n\n b\n") == "A\n\nb"


def test_upsert_prune_and_skips(spark):
    kind = f"map<string,{P.OPS}>"
    out = run(spark, P.upsert(F.col("m"), F.lit("P1"), F.col("o"), F.lit("a"), F.lit("b")), m=({"P2": []}, kind), o=ops((0, 1, "b")))
    assert set(out) == {"P1", "P2"}
    assert run(spark, P.upsert(F.col("m"), F.lit("P1"), F.col("o"), F.lit("a"), F.lit("a")), m=({"P1": []}, kind), o=ops()) is None
    skips = lambda add: run(spark, P.set_skip(F.col("s"), F.array(F.lit("P1"), F.lit("P2")), F.lit("P1"), F.lit(add)), s=([" ", None, "P2", "P9"], "array<string>"))
    assert skips(True) == ["P1", "P2"] and skips(False) == ["P2"]


def fix(spark, f, text, pairs, hints=()):
    kind = "array<struct<match:string,replacement:string>>"
    return run(spark, f(F.col("t"), F.col("c"), F.col("h"), F.lit("P1")), t=(text, "string"), c=(list(pairs), kind), h=(list(hints), "array<string>"))


def test_arabic_corrections(spark):
    out = fix(spark, C.fix_arabic_leaks, "a بد b بد", [("بد", "one"), ("بد", "one"), ("x", "y"), ("سلام", "z")], ["بد", "سلام"])
    assert out.text == "a one b one" and out.changed and [(h.start, h.end, h.title) for h in out.highlights] == [(2, 5, "بد"), (8, 11, "بد")]
    assert out.issues == ['Skipping non-Arabic correction "x" in excerpt P1.', 'Could not find "سلام" in excerpt P1.']
    assert fix(spark, C.fix_arabic_leaks, "a بد", [("بد", "x")], ["نص"]).issues == ['Skipping unmatched Arabic correction "بد" in excerpt P1.']


def test_caps_corrections(spark):
    out = fix(spark, C.fix_all_caps, "IT IS (SO).", [("IT IS (SO).", "It is (so).")], [" IT IS (SO). "])
    assert out.text == "It is (so)." and not out.issues
    assert fix(spark, C.fix_all_caps, "It", [("It", "x")]).issues == ['Skipping non-ALL-CAPS correction "It" in excerpt P1.']


def test_parse_replies(spark):
    good = '{"corrections":[{"id":"P1","match":"a","replacement":"b"},{"id":"P1","match":"a","replacement":"b"},{"id":" ","match":"a","replacement":"b"}]}'
    rows = [good, "text " + good + " trailing }", '{"results":{"P2":[{"match":"m","replacement":"r"},{"match":"","replacement":"r"}]}}', '{"corrections":[{"id":1}]}', "nothing", None]
    out = [r.x for r in spark.createDataFrame([(r,) for r in rows], "t string").select(C.parse_corrections("t").alias("x")).collect()]
    assert [tuple(c) for c in out[0]] == [("P1", "a", "b")] and out[1] == out[0] and [tuple(c) for c in out[2]] == [("P2", "m", "r")] and out[3:] == [None] * 3


def test_dictionary_and_deduplication(spark):
    rows = spark.createDataFrame([(1, " بد ", "f", "P1", "one"), (2, "بد", "g", "P2", "two"), (3, "بد", "f", "P3", "one"), (4, " ", "f", "P4", "x")], "pos long, match string, path string, id string, replacement string")
    (r,) = C.dictionary(rows).collect()
    assert r.match == "بد" and r.observations == ["f#P1", "g#P2", "f#P3"] and r.responses == ["one", "two"]
    assert C.first_of_each(rows.withColumn("id", F.lit("P1"))).count() == 4


def test_edits_of_long_texts_are_small_and_right():
    import random
    import time

    rng = random.Random(1)
    text = "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 40))) for _ in range(1500))
    words = text.split(" ")
    for _ in range(40):
        words[rng.randrange(len(words))] = rng.choice(["new", "", "other words"])
    after = "start " + " ".join(words) + " end"
    began = time.perf_counter()
    found = P.differences(text, after)
    assert time.perf_counter() - began < 20
    out, at = [], 0
    for i, j, k, m in found:
        out += [text[at:i], after[k:m]]
        at = j
    assert "".join(out) + text[at:] == after and sum(m - k for _, _, k, m in found) < 2000
    assert len(P.edits(text, after)) == 1  # so many edits over all of a text are one replacement


GOOD = {"appliedAt": "2026-01-01", "source": {"kind": "llm", "model": "m", "provider": "google", "task": "all_caps_correction"}}
R = {"start": 1, "end": 2}


def changed(**parts):
    return {k: v for k, v in (GOOD | parts).items() if v is not ...}


METADATA = [
    (GOOD, True), (changed(other=[1]), True), (changed(highlights=[{"range": R, "title": "t"}, {"range": R}]), True), (changed(highlightRanges=[R, {"start": 0, "end": 0}]), True), (changed(highlights=[]), True),
    (changed(source=GOOD["source"] | {"modelVersion": "v"}), True), (changed(appliedAt=...), False), (changed(appliedAt=5), False), (changed(source="x"), False), (changed(source=GOOD["source"] | {"kind": "me"}), False),
    (changed(source=GOOD["source"] | {"provider": "else"}), False), (changed(source=GOOD["source"] | {"task": 1}), False), (changed(source=GOOD["source"] | {"model": None}), False),
    (changed(source=GOOD["source"] | {"modelVersion": 4}), False), (changed(highlights={}), False), (changed(highlights=[{"range": {"start": 2, "end": 1}}]), False), (changed(highlights=[{"range": R, "title": 3}]), False),
    (changed(highlightRanges=[{"start": -1, "end": 1}]), False), (changed(highlightRanges=[{"start": 1.5, "end": 2}]), False), (changed(highlightRanges=[{"start": "1", "end": 2}]), False), (changed(highlightRanges=[R, None]), False),
    (changed(highlightRanges=[{"start": 1.0, "end": 2.0}]), True), ([1], False), ("x", False), (None, False),
]


def test_metadata_is_checked_field_by_field(spark):
    import json

    df = spark.createDataFrame([(i, json.dumps(m)) for i, (m, _) in enumerate(METADATA)], "i int, j string").withColumn("v", F.parse_json("j"))
    got = {r.i: r.ok for r in df.select("i", P.metadata_is_valid(F.col("v")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(METADATA)}
    rows = spark.createDataFrame([(json.dumps({"a": GOOD | {"highlightRanges": [R]}, "b": {"appliedAt": "x"}}),)], "j string").select(P.metadata(F.from_json("j", "map<string,variant>")).alias("m")).first()
    assert list(rows.m) == ["a"] and rows.m["a"].source.model == "m" and rows.m["a"].highlightRanges[0].end == 2
