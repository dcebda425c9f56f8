import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream.sources import conversations as S
from quillstream.sources import corpus_files, json_items

HARD = ['}', '{"a":[1]}', '\\', '\\"', '"}', "]", "[{", "a\\\\}", "ünï 😀", "\n\t", "", "plain words here"]


def corpus(rng, n):
    item = lambda p, i: {"id": f"{p}{i}", "nass": rng.choice(HARD) * rng.randrange(3), "text": rng.choice([None, *HARD]), "translator": rng.choice([None, 879]), "lastUpdatedAt": i,
                         "meta": rng.choice([{}, {"alt": [{"text": rng.choice(HARD), "translator": 1, "lastUpdatedAt": 2}] * rng.randrange(3)}, {"patched": {"type": rng.choice(HARD), "appliedAt": 1, "model": "m"}}])}
    return {"createdAt": 5, "promptId": "a}b", "excerpts": [item("P", i) for i in range(n)], "flags": ["x]", "}"], "other": {"deep": {"excerpts": [{"id": "no"}]}}, "headings": [item("T", i) for i in range(rng.randrange(3))],
            "promptForTranslation": rng.choice(HARD) * 2, "footnotes": [], "lastUpdatedAt": 9}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_a_split_corpus_file_is_what_one_task_reads(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent)
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(corpus(rng, 150), indent=indent, ensure_ascii=rng.random() < 0.5))
    whole = corpus_files.read_corpus(spark, str(path))
    split = json_items.pieces(spark, str(path))
    assert split.rdd.getNumPartitions() > 8 and whole.rdd.getNumPartitions() == 1
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(corpus_files.read_segments(spark, str(path))) == key(corpus_files.segments(whole))
    assert key(corpus_files.read_meta(spark, str(path))) == key(corpus_files.meta(whole))


def test_several_files_a_broken_one_and_odd_objects(spark, tmp_path, small_splits):
    files = {
        "a": '{"conversations": [{"x": 1}, {"x": {"y": [{"z": "}"}]}}]}', "b": '{"conversations": [{"x": 2}, {"x": "broken', "c": "{}", "d": '{"one": {"conversations": [{"x": 9}]}, "two": [1, [2], "}"], "conversations": [ {"x":3} ] }',
        "e": "[]", "f": "", "h": '{"conversations": [{"x": 4}, {"x": 5', "i": '{"conversations": [{"x": 6}]}\n\n', "g": '{"n\\"ame": [{"a": 1}], "empty": [], "conversations": []}\n',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = json_items.items(json_items.pieces(spark, str(tmp_path)), 3).collect()
    got = sorted((r.path[-6], r.collection, r.idx, json.dumps(json.loads(r.json))) for r in found)
    assert got == [("a", "conversations", 0, '{"x": 1}'), ("a", "conversations", 1, '{"x": {"y": [{"z": "}"}]}}'), ("b", "conversations", 0, '{"x": 2}'), ("d", "conversations", 0, '{"x": 3}'), ("g", 'n"ame', 0, '{"a": 1}'), ("h", "conversations", 0, '{"x": 4}'), ("i", "conversations", 0, '{"x": 6}')]


def test_archives_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_items, "_BLOCK", 64)
    rng = random.Random(3)
    talks = [{"conversation": {"id": f"c{i // 2}", "title": rng.choice(HARD)}, "responses": [{"n": i}]} for i in range(40)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("deep/er/export.json", json.dumps({"conversations": talks}))
        z.writestr("other.json", "{}")
    pieces = json_items.archive_pieces(spark, str(tmp_path), "export.json")
    got = {r.conversation_id: json.loads(r.content) for r in S.mass_export_items(pieces).collect()}
    assert got == {t["conversation"]["id"]: t for t in talks}
    whole = S.read_archives(spark, str(tmp_path), "export.json").first()
    assert json.loads(whole.content) == {"conversations": talks}
    same = S.mass_export(S.read_archives(spark, str(tmp_path), "export.json")).select("conversation_id", F.parse_json("content").cast("string").alias("c")).collect()
    assert {r.conversation_id: json.loads(r.c) for r in same} == got


def test_no_text_is_shuffled_but_what_lies_across_splits(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(corpus(random.Random(5), 50)))
    for read in (json_items.items, json_items.members):
        plan = read(json_items.pieces(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_items_longer_than_splits(spark, tmp_path, small_splits):
    """Splits that begin in a string, that hold no item's end, and that a top-level object fills."""
    rng = random.Random(9)
    value = lambda: rng.choice(['}{"[', '\\"}', "\\\\", "]"]) * rng.choice([0, 1, 2, 1_500])
    for k in range(6):
        made = {"n": k, "first": [{"id": i, "x": value(), "deep": [{"y": value()}] * rng.randrange(3)} for i in range(rng.randrange(12))], "middle": {"o": {"p": value()}, "q": [{"r": 1}] * 300}, "text": value(), "last": [{"id": i, "x": value()} for i in range(rng.randrange(12))], "end": [value()]}
        (tmp_path / f"{k}.json").write_text(json.dumps(made))
    for parts in (None, 3):
        found = json_items.items(json_items.pieces(spark, str(tmp_path)), parts).collect()
        wanted = []
        for k in range(6):
            made = json.loads((tmp_path / f"{k}.json").read_text())
            wanted += [(f"{k}.json", c, i, json.dumps(x)) for c in ("first", "last") for i, x in enumerate(made[c])]
        assert sorted((r.path[-6:], r.collection, r.idx, json.dumps(json.loads(r.json))) for r in found) == sorted(wanted)
        plain = {}
        for r in json_items.members(json_items.pieces(spark, str(tmp_path)), parts).collect():
            plain.setdefault(r.path[-6:], {}).update(json.loads(r.json))
        for k in range(6):
            made = json.loads((tmp_path / f"{k}.json").read_text())
            assert plain[f"{k}.json"] == {c: x for c, x in made.items() if c in ("n", "text", "end") or x == []}  # an empty array is a plain value
