import io
import json
import zipfile

from quillstream.sources import conversations as S
from quillstream.sources import corpus_files


def message(role, parts=None, t=10, **more):
    content = {"content_type": "text", "parts": parts} if parts is not None else more.pop("content")
    return {"author": {"role": role}, "create_time": t, "update_time": None, "content": content, "metadata": more.pop("metadata", {})}


def tree(model="gpt-5", times=(20, 41), **changes):
    nodes = {
        "root": {"message": None, "parent": None}, "u": {"message": message("user", ["Prompt"]), "parent": "root"},
        "a1": {"message": message("assistant", t=times[0], content={"content_type": "thoughts", "thoughts": [{"content": " think "}]}), "parent": "u"},
        "a2": {"message": message("assistant", [" Response ", {"image": 1}], times[1], metadata={"model_slug": model, "n": 1}), "parent": "a1"},
    }
    nodes |= changes.pop("nodes", {})
    return {"title": "T", "create_time": 1.5, "update_time": 2, "conversation_id": "c", "current_node": "a2", "default_model_slug": "auto", "moderation_results": [], "plugin_ids": None,
            "safe_urls": [], "blocked_urls": [], "mapping": nodes} | changes


def parse(spark, *docs):
    rows = [(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    out = S.to_common(spark.createDataFrame(rows, "path string, content string")).collect()
    return sorted(out, key=lambda r: int(r.path))


def test_tree_exports(spark):
    recap = {"r": {"message": message("assistant", t=30, content={"content_type": "reasoning_recap", "content": "Thought for 22s"}), "parent": "a1"}}
    later = tree(nodes=recap)
    later["mapping"]["a2"]["parent"] = "r"
    loop = tree()
    loop["mapping"]["root"]["parent"] = "a2"
    found = parse(spark, tree(), later, tree("gemini-3-pro"), tree("grok-4", (20, 36)), tree("gemini-3-pro", (20, 20)), loop, tree("auto"), tree(current_node="gone"), tree(nodes={"a2": {"message": message("assistant", ["x"]), "parent": "a1"}}, default_model_slug="grok-2"))
    assert [(r.shape, r.llm, r.prompt, r.response, r.reasoning, r.reasoning_sec) for r in found[:5]] == [
        ("tree", "ChatGPT", "Prompt", "Response", ["think"], None), ("tree", "ChatGPT", "Prompt", "Response", ["think", "Thought for 22s"], 22.0),
        ("tree", "Gemini", "Prompt", "Response", ["think"], 21.0), ("tree", "Grok", "Prompt", "Response", ["think"], 16.0), ("tree", "Gemini", "Prompt", "Response", ["think"], None),
    ]
    assert found[5].response == "Response" and found[6].error == "Could not detect model" and found[7].response == "Response" and found[8].model == "grok-2"
    assert found[0].created_at == "1970-01-01T00:00:01.500Z"


def test_other_shapes(spark):
    chat = {"conversation": {"id": "g", "title": ""}, "responses": [{"response": {"sender": "human", "message": "old"}}, {"response": {"sender": " Human ", "message": " ask "}}, {"response": {
        "sender": "assistant", "message": "answer", "model": "grok-3", "metadata": {"request_metadata": {"model": "grok-4"}}, "thinking_start_time": {"$date": {"$numberLong": "1774755278975"}},
        "thinking_end_time": {"$date": {"$numberLong": "1774755398508"}}, "agent_thinking_traces": [{"thinking_trace": " a "}], "steps": [{"tag_order": ["y", "x"], "tagged_text": {"x": "a", "y": "b"}}]}}]}
    found = parse(spark, chat, {"format": "original", "data": tree(), "__edits": {"skip": ["P1"]}}, {"payload": tree()}, {"data": {"payload": tree(), "__edits": {"a": 1}}},
                  {"format": "common", "prompt": "p", "response": "r", "model": "m", "llm": "L"}, {"hello": "world"}, "{bad", "[]", "")
    assert [r.shape for r in found] == ["chat", "wrapper", "wrapper", "wrapper", "common", "unknown", "unreadable", "unknown", "unreadable"]
    assert (found[0].prompt, found[0].response, found[0].model, found[0].llm, found[0].reasoning, found[0].reasoning_sec, found[0].title) == ("ask", "answer", "grok-4", "Grok", ["a", "b"], 120.0, None)
    assert found[1].edits == '{"skip":["P1"]}' and found[3].edits == '{"a":1}' and found[4].response == "r" and found[5].error and found[6].error == "not JSON"


def test_files_archives_and_mass_exports(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("z.json", "b/a.json", "b/skip.txt"):
        (tmp_path / name).write_text(json.dumps({"format": "common", "response": name}))
    rows = S.in_tree_order(S.read_files(spark, str(tmp_path))).orderBy("file_order").collect()
    assert [r.path for r in rows] == ["b/a.json", "z.json"] and rows[0].size > 10 and rows[0].modified_ms > 10**12
    export = {"conversations": [{"conversation": {"id": "x"}, "responses": [1]}, {"conversation": {"id": "y"}}, {"conversation": {"id": "x"}, "responses": [2]}]}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("deep/in/export.json", json.dumps(export))
        z.writestr("other.json", "{}")
    (tmp_path / "e.zip").write_bytes(data.getvalue())
    found = S.mass_export(S.read_archives(spark, str(tmp_path), "export.json")).collect()
    assert {r.conversation_id: json.loads(r.content).get("responses") for r in found} == {"x": [2], "y": None}


def test_corpus_files_and_prompts(spark, tmp_path):
    item = {"id": "P1", "nass": "n", "text": "t", "translator": 879, "lastUpdatedAt": 5, "meta": {"alt": [{"text": "a"}], "patched": {"type": "all_caps_correction"}}}
    corpus = {"createdAt": 1, "lastUpdatedAt": 9, "promptForTranslation": "do", "excerpts": [item, {"id": "P2", "nass": "n"}], "headings": [{"id": "T1", "nass": "h", "parent": "P1"}], "footnotes": []}
    (tmp_path / "c.json").write_text(json.dumps(corpus, indent=1))
    raw = corpus_files.read_corpus(spark, str(tmp_path / "c.json"))
    rows = {r.id: r for r in corpus_files.segments(raw).collect()}
    assert (rows["P1"].alt_count, rows["P1"].patch_type, rows["P2"].text, rows["P2"].alt_count, rows["P2"].idx, rows["T1"].collection) == (1, "all_caps_correction", None, 0, 1, "headings")
    assert corpus_files.meta(raw).first().prompt == "do"
    (tmp_path / "master.md").write_text("M")
    (tmp_path / "fiqh-rules.md").write_text("F")
    prompts = corpus_files.read_prompts(spark, str(tmp_path))
    assert {(r.id, r.name, r.is_master) for r in prompts.collect()} == {("MASTER", "Master", True), ("FIQH_RULES", "Fiqh Rules", False)}
    assert corpus_files.select_prompt(prompts).first().id == "FIQH_RULES" and corpus_files.select_prompt(prompts, "MASTER").first().content == "M"
