import pytest
from pyspark.sql import functions as F

from quillstream.operators import playback, running


def candidates(spark, rows):
    return spark.createDataFrame([(i, n, f"f{n}", 0, f"t{n}", 879, n) for n, i in enumerate(rows)], "id string, file_order int, path string, pos int, text string, translator int, last_updated_at long")


@pytest.mark.parametrize("common, written", [(1_000_000, 0), (3, 1)])
def test_only_very_common_keys_are_written_to_be_ranked(spark, monkeypatch, common, written):
    calls, real = [], running.materialize
    monkeypatch.setattr(running, "materialize", lambda df: calls.append(1) or real(df))
    monkeypatch.setattr(running, "COMMON", common)
    rows = [("a", None, "b", "a", "a", None, "a", "a")[n % 8] for n in range(40)]
    found = running.ranks(candidates(spark, rows), ["id"], ["file_order", "pos"], "nth")
    wanted = {n: rows[: n + 1].count(i) for n, i in enumerate(rows)}
    assert {r.file_order: r.nth for r in found.collect()} == wanted and len(calls) == written


def test_playback_with_ids_in_every_state(spark):
    segments = spark.createDataFrame([("excerpts", 1, "a", None, 1, 5), ("excerpts", 2, "b", "x", 2, 6), ("excerpts", 3, "d", "", 3, 7)], "collection string, idx int, id string, text string, translator int, last_updated_at long")
    found = playback.classify(candidates(spark, ["a", "u", "a", "b", "u", "a", "d"]), segments)
    assert {(r.kind, r.id): r.paths for r in playback.issues(found).collect()} == {("duplicate", "a"): "f0,f2,f5", ("unknown", "u"): "f1,f4", ("already_translated", "b"): "f3"}
    merged = {r.id: (r.text, [x.text for x in r.alt]) for r in playback.merge(segments, found).collect()}
    assert merged == {"a": ("t0", ["t2", "t5"]), "b": ("x", []), "d": ("t6", [])}
    assert playback.counters(found).first().asDict() == {"candidates": 7, "applied": 4, "unknown": 2, "already_translated": 1}
    assert playback.counters(found.where(F.lit(False))).first().asDict() == {"candidates": 0, "applied": 0, "unknown": 0, "already_translated": 0}
