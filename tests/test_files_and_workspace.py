import json
import os

import pytest

from quillstream.operators import files, packing
from quillstream.plans import tables
from quillstream.plans.workspace import Workspace, assist


@pytest.fixture
def rows(spark):
    data = [("a/b/x.json", "m", True, 1, 5.0), ("a/y.json", None, False, 2, 40.0), ("z.json", "m", False, 0, None)]
    return spark.createDataFrame(data, "path string, model string, is_valid boolean, patches_applied int, thinking_sec double")


def test_file_statistics(rows):
    assert tuple(files.stats(rows).first()) == (3, 1, 2, 3)
    assert {r.model: (r.files, r.invalid) for r in files.by_model(rows).collect()} == {"m": (2, 1), "unknown": (0, 1)}
    assert {r.bucket: r.files for r in files.thinking_times(rows).collect()} == {"lt_10s": 1, "30_to_60s": 1}


def test_tree_and_filters(rows):
    tree = {r.path: (r.kind, r.parent, r.files) for r in files.tree(rows).collect()}
    assert tree == {"a": ("directory", "", 2), "a/b": ("directory", "a", 1), "a/b/x.json": ("file", "a/b", 1), "a/y.json": ("file", "a", 1), "z.json": ("file", "", 1)}
    assert {r.path for r in files.tree(files.matching(rows, "m", "invalid")).collect()} == {"z.json"}
    assert files.without(rows, ["z.json"]).count() == 2
    with pytest.raises(ValueError):
        files.without(rows, ["../z.json"])
    assert not files.is_safe("/x") and not files.is_safe("") and files.is_safe("a/b.json")


def test_filters_and_numbers():
    assert files.filters({"model": " grok-4 ", "status": "odd", "thinking_time": None}, {"thinking_time": "lt_10s"}) == {"model": "grok-4", "status": "all", "thinking_time": "lt_10s"}
    assert files.filters({}) == {"model": "all", "status": "all", "thinking_time": "all"}
    n = packing.whole_number
    assert (n(" 7 ", 5), n("x", 5), n(None, 5), n("0", 5), n("0", 5, least=0), n("900", 5, 100), n("-3", 2)) == (7, 5, 5, 5, 0, 100, 2)


def test_what_users_write_is_kept(spark, tmp_path):
    folder = tmp_path / "chats"
    folder.mkdir()
    chat = {"format": "common", "model": "grok-4", "prompt": "P1 - نص\nP3 - نص", "created_at": "2026-01-01T00:00:00Z", "response": "P1 - one بد\nP3 - three"}
    for name in ("a.json", "b.json", "c.json"):
        (folder / name).write_text(json.dumps(chat))
    table = spark.createDataFrame([("excerpts", 0, "P1", "نص", None)], "collection string, idx int, id string, nass string, text string")
    table.write.partitionBy("collection").parquet(str(tmp_path / "segments"))
    ws = Workspace(spark, str(tmp_path / "segments"), str(folder), state_path=str(tmp_path / "state"))
    valid = lambda: {r.path: r.is_valid for r in ws.validate_all().collect()}
    assert valid() == {"a.json": False, "b.json": False, "c.json": False}
    ops = "array<struct<start:int,end:int,text:string>>"
    schema = f"path string, id string, ops {ops}, metadata string, skip boolean"
    ws.save_edits(spark.createDataFrame([("a.json", "P1", [(3, 6, "")], None, None), ("b.json", "P1", None, None, True)], schema))
    assert valid() == {"a.json": True, "b.json": True, "c.json": False}
    ws.save_edits(spark.createDataFrame([("b.json", "P1", None, None, False)], schema))
    assert valid() == {"a.json": True, "b.json": False, "c.json": False}
    assert ws.delete(["c.json", "none.json"]) == 1 and set(valid()) == {"a.json", "b.json"}
    with pytest.raises(ValueError):
        ws.delete(["../segments"])
    prompts = spark.createDataFrame([("MASTER", "Master", "M", True), ("A", "A", "do a", False)], "id string, name string, content string, is_master boolean")
    assert ws.prompt() is None
    ws.set_prompt(prompts, "A", 7)
    assert (ws.prompt().first().prompt, ws.prompt().first().prompt_id, ws.prompt().first().last_updated_at) == ("do a", "A", 7)
    with pytest.raises(ValueError):
        ws.set_prompt(prompts, "B", 8)
    made = []
    snap = lambda: tables.snapshot(spark, str(tmp_path / "snap"), str(folder / "a.json"), lambda: made.append(1) or spark.range(len(made)))
    assert snap().count() == 1 and snap().count() == 1 and len(made) == 1
    os.utime(folder / "a.json", (1, 1))
    assert snap().count() == 2


def test_workspace(spark, tmp_path):
    item = lambda i, **more: {"id": i, "nass": "نص"} | more
    corpus = {"excerpts": [item("P1"), item("P2", text="done", translator=879), item("P3")], "headings": [item("T1")], "footnotes": []}
    (tmp_path / "corpus.json").write_text(json.dumps(corpus))
    folder = tmp_path / "chats"
    (folder / "sub").mkdir(parents=True)
    chat = {"format": "common", "model": "grok-4", "prompt": "P1 - نص\nP3 - نص", "created_at": "2026-01-01T00:00:00Z"}
    (folder / "sub/good.json").write_text(json.dumps(chat | {"response": "P1 - one\nP3 - three"}))
    (folder / "bad.json").write_text(json.dumps(chat | {"response": "P1 - one بد\nP3 - three"}))
    ws = Workspace.from_corpus_file(spark, str(tmp_path / "corpus.json"), str(tmp_path / "segments"), conversations_path=str(folder))
    assert ws.stats().first().untranslated_segments == 3 and ws.untranslated().count() == 3 and ws.picker().count() == 3
    assert ws.payload("Do this").first().payload == "Do this\n\nP1 - نص\nP3 - نص" and ws.shift("").first().item_count == 3
    assert {r.path: r.is_valid for r in ws.validate_all().collect()} == {"sub/good.json": True, "bad.json": False}
    assert ws.dashboard()["files"].first().valid_files == 1 and ws.invalid().first().leak_hints == ["بد"] and ws.review("bad.json").count() == 2 and ws.tree(status="valid").count() == 2
    done = ws.simulate_playback()
    assert done["counters"].first().applied == 2 and {r.id: r.text for r in done["merged"].collect()} == {"P1": "one", "P2": "done", "P3": "three", "T1": None}
    saved = ws.save_playback(str(tmp_path), "corpus", "2026-01-01T00:00:00Z")
    assert spark.read.parquet(saved).count() == 4 and set(ws.analytics()) >= {"timeline", "translators"}
    suggested = assist(ws.invalid(), lambda rows: [{"id": r["id"], "match": "بد", "replacement": "bad"} for r in rows])
    fixed = ws.corrected(suggested).first()
    assert fixed.fixed.text == "one bad" and fixed.patch[0].text == "bad"
