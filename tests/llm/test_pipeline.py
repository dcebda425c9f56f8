import random
import shutil

import pytest

import corpus_pipeline as cp
from quillstream.llm.common import stash
from .conftest import prose


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(4)
    base = [prose(rng, 150, 3000) for _ in range(40)]
    bench = prose(rng, 40, 3000)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0", 1), (101, base[1].replace("w1", "x1", 1), "en", "s1", 1), (102, "... 12 34", "en", "s1", 1), (103, None, "en", None, None), (104, base[2].split("\n")[0] + "\n" + bench, "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    yield str(tmp_path)
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_each_stage_takes_effect_and_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = []
    for name, stage in cp.STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        if name != "mixing":
            assert docs.columns == list(cp.COLUMNS)
        ids.append({r.doc_id for r in docs.collect()})
    clean = set(range(40))
    assert all(clean <= x for x in ids)
    assert not {102, 103} & ids[0] and 100 not in ids[1] and 104 in ids[2] and 104 not in ids[3] and ids[4] == ids[3]
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert {"taken", "target", "source_size", "size"} <= set(docs.columns) and docs.agg({"taken": "sum"}).first()[0] > 0


def test_near_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    base = prose(rng, 300, 5000)
    rows = [(i, base.replace("w1", f"y{i}", 1), "en", "a", 1) for i in range(6)] + [(9, prose(rng, 200, 5000), "en", "a", 1), (10, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()} == {0, 9, 10}


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stash(stage(spark, docs, sf_dir), "again")
    assert sorted(cp.run(spark, sf_dir).collect()) == sorted(docs.collect())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_stage_tells_rows_of_one_id_apart(spark):
    rng = random.Random(6)
    base = [prose(rng, 200, 5000) for _ in range(4)]
    rows = [(7, base[0], "en", "a", 1)] * 3 + [(3, base[1], "en", "a", 1), (5, base[1], "en", "a", 1), (5, base[2], "en", "a", 1), (5, base[2].replace("w1", "y1", 1), "en", "a", 1)]
    rows += [(None, base[3], "en", "a", 1), (None, "", None, None, None)]
    found = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == [3, 5, 7]
    assert sorted(r.text for r in found if r.doc_id is None) == ["", base[3]]
    assert {r.doc_id: r.text for r in found}[3] == base[1] and {r.doc_id: r.text for r in found}[5] != base[1]


def test_mix_stage_keeps_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(7)
    rows = [(i % 20 if i % 4 else None, prose(rng, 30 + i, 3000), "en", None if i % 7 == 0 else f"s{i % 3}", i) for i in range(60)]
    rows += [(1, "same words here", "en", "s0", 90)] * 3
    found = cp.mix(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in found))) == sorted(map(str, rows))
    assert all(r.size == len(r.text.split()) and 0 <= r.taken <= 3 * r.size for r in found)
    words = sum(r.size for r in found)
    assert words <= sum(r.taken for r in found) < words + 32 * 4


def test_run_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(8)
    base = [prose(rng, 150, 3000) for _ in range(30)]
    rows = [(None if i < 3 else i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [rows[9]] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(rng, 40, 3000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = cp.run(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in found) == sorted(base)
    assert sum(r.doc_id is None for r in found) == 3 and all(r.taken <= 3 * r.size for r in found)
