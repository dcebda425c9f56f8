import json

import pytest

from quillstream.operators import files, playback
from quillstream.plans import validity as V
from quillstream.plans.tables import materialize
from quillstream.sources.conversations import to_common


def common(prompt, response, model="gpt-5-4-pro", **more):
    return {"format": "common", "prompt": prompt, "response": response, "model": model, "updated_at": "2026-01-02T00:00:00Z"} | more


@pytest.fixture(scope="module")
def analyses(spark):
    docs = {
        "d/patched.json": common("Eg P9 - x\n\nP1 - نص\nP2 - نص", "P1 - hello بد world\nP2 - fine", __edits={"patches": {"P1": {"ops": [{"start": 6, "end": 8, "text": "bad"}]}}}),
        "leak.json": common("P1 - نص\nP2 - نص", "P1 - hello بد world\nP2 - ok"),
        "hidden.json": common("P1 - نص\nP2 - نص", "P1 - a بد b\nP2 - ok", __edits={"patches": {"P1": {"ops": [{"start": 0, "end": 1, "text": "A"}]}}}),
        "skipped.json": common("P1 - نص\nP2 - نص", "P1 - بد\nP2 - ok", __edits={"skip": ["P1", " "]}),
        "model.json": common("P1 - نص", "P1 - ok", "unheard-of"),
        "diff.json": common("P1 - نص", "P1 - old", "grok-4", __edits={"patches": {"P1": "@@ -1 +1 @@\n-old\n+new\n"}}),
        "missing.json": common("P1 - نص\nP2 - نص\nP3 - نص", "P1 - one\nP3 - three"),
        "bad.json": None,
    }
    rows = [(k, "{" if v is None else json.dumps(v)) for k, v in docs.items()]
    return materialize(V.analyse(materialize(to_common(spark.createDataFrame(rows, "path string, content string")))))


def test_files(analyses):
    by = {r.path: r for r in analyses.collect()}
    assert {p for p, r in by.items() if r.is_valid} == {"d/patched.json", "hidden.json", "skipped.json", "diff.json"}
    assert by["model.json"].error == "Invalid model: unheard-of" and by["bad.json"].error == "not JSON"
    assert [e.text for e in by["d/patched.json"].playable] == ["hello bad world", "fine"] and by["d/patched.json"].playable[0].translator == 903
    assert by["hidden.json"].playable == [] and by["hidden.json"].patches_applied == 1  # hidden errors leave nothing to play
    assert [e.text for e in by["diff.json"].playable] == ["new"] and [e.id for e in by["skipped.json"].playable] == ["P2"]
    # the response is rebuilt in source order: a missing translation shows as an empty segment
    assert {e.type for e in by["missing.json"].visible_errors} >= {"invalid_marker_format", "truncated_segment"}


def test_rollups(analyses):
    rows = files.stats(V.file_rows(analyses)).first()
    assert (rows.total_files, rows.valid_files, rows.invalid_files, rows.patches_applied) == (8, 4, 4, 3)
    bad = {(r.path, r.id): r for r in V.invalid_excerpts(analyses).collect()}
    leak = bad["leak.json", "P1"]
    assert leak.leak_hints == ["بد"] and leak.error_types == ["arabic_leak"] and [tuple(x) for x in leak.ranges] == [(6, 8)] and leak.arabic == "نص"
    assert {p for p, _ in bad} == {"leak.json", "missing.json"} and V.fixable(V.invalid_excerpts(analyses)).count() == 1
    review = {(r.path, r.id): r for r in V.review_rows(analyses).collect()}
    assert review["d/patched.json", "P1"].has_patch and review["missing.json", "P2"].is_missing and review["hidden.json", "P1"].messages


def test_candidates_play_back(spark, analyses):
    found = V.candidates(analyses)
    order = [r.path for r in found.select("file_order", "path").distinct().orderBy("file_order").collect()]
    assert order == ["d/patched.json", "diff.json", "skipped.json"]
    segments = spark.createDataFrame([("excerpts", 0, "P1", None), ("excerpts", 1, "P2", "done")], "collection string, idx long, id string, text string").selectExpr("*", "cast(null as int) translator", "cast(null as bigint) last_updated_at", "'n' nass")
    classified = playback.classify(found, segments)
    row = playback.counters(classified).first()
    assert (row.candidates, row.applied, row.unknown, row.already_translated) == (4, 2, 0, 2)
    merged = {r.id: r for r in playback.merge(segments, classified).collect()}
    assert merged["P1"].text == "hello bad world" and [a.text for a in merged["P1"].alt] == ["new"] and merged["P2"].text == "done"
    assert {(r.kind, r.id): r.paths for r in playback.issues(classified).collect()} == {("duplicate", "P1"): "d/patched.json,diff.json", ("already_translated", "P2"): "d/patched.json,skipped.json"}


def test_raw_responses_show_what_rebuilding_hides(spark):
    rows = spark.createDataFrame([("a", json.dumps(common("P1 - نص\nP2 - نص", "P2 - b\nP1 - a")))], "path string, content string")
    types = [e.message for e in V.validate_raw(materialize(to_common(rows))).first().errors]
    assert types == ['Translated response contains ID "P1" which does not exist in the Arabic source.']
