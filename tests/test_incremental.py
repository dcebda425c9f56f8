import json
import os

import pytest

from quillstream.operators import corpus
from quillstream.plans import incremental
from quillstream.plans.workspace import Workspace, assist
from quillstream.sources import corpus_files


def item(i, **more):
    return {"id": f"P{i}", "nass": "n"} | more


def write(folder, name, n, **more):
    rows = [item(i, text=["", "x", None][i % 3], translator=[None, 879, 890, 0][i % 4], lastUpdatedAt=1_700_000_000 + i % 6 * 4_000_000, meta={"alt": [{"text": "a"}] * (i % 3), "patched": {"type": "all_caps_correction"}} if i % 2 else {}) for i in range(n)]
    (folder / name).write_text(json.dumps({"excerpts": rows, "headings": rows[: n // 2], "footnotes": []} | more))


def results(rows):
    found = {
        "stats": corpus.stats(rows, 1, 2), "counts": corpus.counts(rows), "translators": corpus.translator_shares(rows), "alternatives": corpus.alternatives(rows), "patch_types": corpus.patch_types(rows),
        "timeline": corpus.timeline(rows), "distinct": corpus.distinct_translators(rows),
    }
    return {k: sorted(map(repr, v.collect())) for k, v in found.items()}


def test_facts_give_the_statistics_of_their_segments(spark, tmp_path):
    write(tmp_path, "a.json", 90)
    whole = corpus_files.segments(corpus_files.read_corpus(spark, str(tmp_path / "a.json")))
    facts = corpus.facts(whole)
    assert results(whole) == results(facts) == results(corpus.facts(facts.union(facts.limit(0)))) and facts.count() < whole.count()


def test_one_changed_file_is_read_and_totals_are_those_of_a_full_run(spark, tmp_path, monkeypatch):
    folder, table = tmp_path / "in", str(tmp_path / "facts")
    folder.mkdir()
    for k in range(4):
        write(folder, f"{k}.json", 10 * k)
    read = []
    real = incremental.pieces
    monkeypatch.setattr(incremental, "pieces", lambda spark, paths, glob: read.append(sorted(os.path.basename(p) for p in paths)) or real(spark, paths, glob))
    facts = lambda: incremental.merged(incremental.kept_facts(spark, str(folder), table))
    full = lambda: results(corpus_files.read_segments(spark, str(folder)))
    assert results(facts()) == full() and read == [["0.json", "1.json", "2.json", "3.json"]]
    assert results(facts()) == full() and len(read) == 1
    write(folder, "2.json", 33)
    os.utime(folder / "2.json", (9, 9))
    assert results(facts()) == full() and read[1:] == [["2.json"]]
    os.remove(folder / "3.json")
    write(folder, "new.json", 4)
    assert results(facts()) == full() and read[2:] == [["new.json"]]
    os.remove(folder / "1.json")
    assert results(facts()) == full() and len(read) == 3


def test_analytics_snapshot_until_the_corpus_changes(spark, tmp_path):
    write(tmp_path, "a.json", 30)
    ws = Workspace.from_corpus_file(spark, str(tmp_path / "a.json"), str(tmp_path / "segments"), state_path=str(tmp_path / "state"))
    first = {k: v.count() for k, v in ws.analytics().items()}
    assert first["counts"] == 2 and os.listdir(tmp_path / "state/facts/version=1")
    assert ws.facts().inputFiles()[0].startswith(f"file://{tmp_path}/state/facts")
    assert sorted(map(repr, ws.analytics()["timeline"].collect())) == sorted(map(repr, corpus.timeline(ws.segments).collect()))


def test_requests_of_one_file_each(spark):
    rows = spark.createDataFrame([(f"f{k % 3}.json", f"P{k // 3:02}", f"t{k}") for k in range(36)], "path string, id string, translation string")
    out = assist(rows, lambda part: [{"id": r["id"], "match": r["path"], "replacement": str(len(part))} for r in part] + [{"id": "P99", "match": "x", "replacement": "y"}]).collect()
    assert len(out) == 36 and all(r.match == r.path for r in out) and {r.replacement for r in out} == {"5", "2"}
    with pytest.raises(Exception, match="twice"):
        assist(rows.union(rows.limit(1)), lambda part: []).count()
