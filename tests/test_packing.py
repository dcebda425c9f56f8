import pytest
from pyspark.sql import functions as F

from quillstream.operators import corpus, packing, playback, running


@pytest.fixture
def queue(spark):
    def make(*rows):
        return spark.createDataFrame([(1, i, "excerpts", a, b) for i, (a, b) in enumerate(rows)], "collection_order int, idx long, collection string, id string, nass string")

    return make


def test_shift_takes_what_fits(queue):
    q = queue(("A1", "aa"), ("A2", "bbb"), ("A3", "cccc"))
    size = lambda c: F.length(c).cast("long")
    row = packing.shift(q, 20, "pp", size).first()
    assert (row.payload, row.item_count, row.used_tokens) == ("pp\n\nA1 - aa\n\nA2 - bbb", 2, 17)
    row = packing.shift(q, 12, "prompt", size).first()
    assert (row.payload, row.item_count, row.used_tokens) == ("prompt", 0, 6)
    row = packing.shift(q, 3, "prompt", size).first()
    assert (row.payload, row.item_count, row.used_tokens) == ("", 0, 0)
    assert packing.shift(q, 16, "", size).first().payload == "A1 - aa\nA2 - bbb"


def test_groups_by_running_cost(spark, queue):
    rows = [("id1", 100), ("id2", 200), ("id3", 1000), ("id4", 4000), ("id5", 4900)]
    grouped = packing.token_groups(queue(*((i, "x" * (n * 4)) for i, n in rows)))
    assert [(r.group_no, r.last_index) for r in packing.group_summary(spark, grouped).collect()] == [(0, 2), (1, 4), (2, -1), (3, -1)]
    big = packing.token_groups(queue(("a", "x" * 40_000)))
    assert [r.last_index for r in packing.group_summary(spark, big).collect()] == [-1, 0, -1, -1]


def test_pages_are_clamped(queue):
    q = queue(*((f"P{i}", "n") for i in range(12)))
    assert [r.id for r in packing.page(q, 9, 5).orderBy("position").collect()] == ["P10", "P11"] and packing.page(q, 0, 5).count() == 5
    assert packing.page(q.limit(0), 3).count() == 0


def test_resume(spark, queue):
    q = queue(("P0", "n"), ("P1", "n"), ("P2", "n"))
    assert {r.id for r in packing.resume(q, shifted_count=1).collect()} == {"P1", "P2"}
    assert {r.id for r in packing.resume(q, spark.createDataFrame([("P1",)], "id string"), 2).collect()} == {"P0", "P2"}
    assert packing.checkpoint_matches(1, 10.468, 10) and not packing.checkpoint_matches(1, 11, 10) and not packing.checkpoint_matches(2, 10, 10)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_do_not_depend_on_parts(spark, parts):
    rows = spark.createDataFrame([(g, i * 7 % 20, i) for g in (2, 1) for i in range(20)], "g int, place long, v long")
    out = running.running_sum(rows, F.col("v"), "total", place="place", within=["g"], parts=parts).orderBy("g", "place").collect()
    total = 0
    for r in out:
        total += r.v
        assert r.total == total


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_places_need_no_window_over_everything(spark):
    """Places of up to 2 ** 60, far apart: as many parts as any other table has, and every window has its part."""
    rows = spark.range(5_000).select(((F.col("id") * 7_919) % 5_000 * (2**47)).alias("place"), F.lit(1).alias("g"), F.col("id"))
    out = running.positions(rows, place="place", within=["g"])
    assert "SinglePartition" not in plan_of(out) and "Window" in plan_of(out)
    assert out.where(F.col("position") != F.col("place") / 2**47 + 1).count() == 0
    near = running.beside(rows, "id", ["g", "place"])
    assert "SinglePartition" not in plan_of(near)
    assert near.where("prev is null").count() == near.where("next is null").count() == 1
    back = near.select(F.col("id").alias("prev"), F.col("next").alias("same")).join(near.select("id", "prev"), "prev")
    assert back.where("same <> id").count() == 0 and back.count() == 4_999


def test_a_very_common_key_is_ranked_in_parts(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 30_000
        rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), F.hash("id").alias("o"), "id")
        out = running.ranks(rows, ["k"], ["o", "id"], "rank", parts=12)
        hot = out.where("k = 'hot'").orderBy("o", "id").select("rank").collect()
        assert [r.rank for r in hot] == list(range(1, len(hot) + 1)) and len(hot) == n * 2 // 3
        assert out.where("k is null").agg(F.max("rank"), F.countDistinct("rank")).first() == (n // 30, n // 30) and out.where("k <> 'hot' and rank > 1").count() == 0
        sizes = [r["count"] for r in running.parted(rows, ["k", "o", "id"], 12).groupBy("_part").count().collect()]
        assert max(sizes) < n / 6
        candidates = rows.select(F.lit("P").alias("id"), F.col("id").alias("file_order"), F.lit(0).alias("pos"), F.concat(F.lit("f"), F.col("id") % 50).alias("path"), F.col("id").cast("string").alias("text"), F.lit(1).alias("translator"), F.lit(2).cast("long").alias("last_updated_at"))
        targets = spark.createDataFrame([("P", None, 0, 0)], "id string, text string, translator int, last_updated_at long")
        found = playback.classify(candidates, targets)
        assert playback.issue_rows(found).count() == 50
        merged = playback.merge(targets, found, arrays=False).first()
        assert merged.text == "0" and merged.alt == [] and playback.alternatives(found).agg(F.max("position")).first()[0] == n - 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_corpus_rollups(spark):
    rows = [("excerpts", 0, "P1", "first", 879, 0), ("excerpts", 1, "P2", None, 890, 1), ("headings", 0, "T1", "heading", None, 2), ("footnotes", 0, "F1", "", 901, 1)]
    s = spark.createDataFrame([(*r[:3], "n", *r[3:5], 1_767_312_000 + r[1] * 86_400, r[5], None) for r in rows], "collection string, idx long, id string, nass string, text string, translator int, last_updated_at long, alt_count int, patch_type string")
    r = corpus.stats(s, 5, 3).first()
    assert (r.total_segments, r.translated_segments, r.untranslated_segments, r.unique_translators, r.work_duration_sec) == (3, 2, 1, 2, 0)
    assert [(a.alt_count, a.label, a.segments) for a in corpus.alternatives(s).collect()] == [(1, "1 alt", 2), (2, "2 alts", 1)]
    (day,) = corpus.timeline(s).collect()
    assert (day.granularity, day.label, day.translated, day.completion_percent) == ("day", "Jan 2", 2, 66.7)
    assert [r.id for r in corpus.untranslated(s).collect()] == ["P2"] and [(t.label, t.percent) for t in corpus.translator_shares(s).collect()] == [("GPT 5o", 100.0)]


def test_timeline_grain_and_slices(spark):
    make = lambda n, translators=(879,): spark.range(n).selectExpr("'excerpts' collection", "id idx", "concat('P', id) id", "'t' text", f"cast(element_at(array({','.join(map(str, translators))}), cast(id % {len(translators)} + 1 as int)) as int) translator", "1767225600 + id * 86400 last_updated_at")
    weeks = corpus.timeline(make(120)).collect()
    assert weeks[0].granularity == "week" and weeks[0].label.startswith("Week of ") and weeks[-1].cumulative_translated == 120
    months = corpus.timeline(make(420)).collect()
    assert months[0].granularity == "month" and months[0].label == "Jan 2026"
    counts = [40, 30, 20, 10, 9, 8, 7, 6, 5, 4]
    shares = corpus.translator_shares(make(sum(counts), [i for i, n in enumerate(counts) for _ in range(n)])).collect()
    assert len(shares) == 8 and (shares[-1].id, shares[-1]["count"], shares[-1].label) == ("other", 15, "Other (3)")


def test_repeated_ids_block_a_merge_and_packing_needs_all(spark, tmp_path):
    s = spark.createDataFrame([("excerpts", 0, "P1", None, None, None), ("excerpts", 1, "P1", None, None, None)], "collection string, idx long, id string, text string, translator int, last_updated_at long")
    c = spark.createDataFrame([("f", "a", 0, "P1", "x", 1, 1)], "file_order string, path string, pos int, id string, text string, translator int, last_updated_at long")
    assert all(r.text is None for r in playback.merge(s, playback.classify(c, s)).collect())
    assert [(r.id, r.places) for r in corpus.duplicate_targets(s).collect()] == [("P1", "excerpts:0,excerpts:1")]
    with pytest.raises(ValueError):
        playback.pack(s, str(tmp_path / "p"))
    path = playback.save(s.fillna("t"), str(tmp_path), "c", "2026-01-01T00:00:00Z")
    assert path.endswith("c_new_2026-01-01T00-00-00Z") and spark.read.parquet(path).count() == 2
