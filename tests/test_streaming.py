import json
import random
import time

import pytest

from pyspark.sql import functions as F

from quillstream.streaming import files, ingest

ROWS = [("a", 1, 15, "k1"), ("a", 2, 15, "k1"), ("a", 3, 14, "k2"), ("a", 4, 20, "k2"), ("b", 5, None, None), ("b", 6, 5, None), ("b", 7, 5, "k9"), ("b", 8, None, "k9"), ("b", 9, 1, None)]
SCHEMA = "id string, arrival long, seq long, key string"
WANTED = ["saved", "duplicate", "stale", "saved", "saved", "saved", "stale", "saved", "saved"]


def events(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("payload", F.col("arrival").cast("string"))


def walk(rows):
    """The state machine, one event after the other."""
    keys, seqs, out = set(), {}, {}
    for id_, arrival, seq, key in sorted(rows, key=lambda r: r[1]):
        if key is not None and key in keys:
            out[arrival] = "duplicate"
        elif seq is not None and seqs.get(id_) is not None and seq <= seqs[id_]:
            out[arrival] = "stale"
        else:
            out[arrival] = "saved"
            seqs[id_] = seq
            if key is not None:
                keys.add(key)
    return out


def made(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, i, i - 3, rng.randrange(n)]), rng.choice([None, f"k{rng.randrange(60)}"])) for i in range(n)]


def test_batch(spark):
    out = ingest.ingest_batch(events(spark)).orderBy("arrival").collect()
    assert [r.outcome for r in out] == WANTED == [walk(ROWS)[i] for i in range(1, 10)]
    kept = {r.id: r.seq for r in ingest.saved(ingest.ingest_batch(events(spark))).collect()}
    assert kept == {"a": 20, "b": 1}


@pytest.mark.parametrize("seed", range(2))
def test_keys_are_global_and_chunks_change_nothing(spark, monkeypatch, seed):
    monkeypatch.setattr(ingest, "CHUNK", [7, 65_536][seed % 2])
    rows = made(seed)
    found = ingest.ingest_batch(spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit("p"))).collect()
    assert {r.arrival: r.outcome for r in found} == walk(rows) and set(walk(rows).values()) == {"saved", "duplicate", "stale"}


def test_a_key_of_another_conversation_is_a_duplicate(spark):
    rows = [("a", 1, 1, "k"), ("b", 2, 1, "k"), ("b", 3, 2**60, "m"), ("b", 4, 2**60 - 1, "n"), ("c", 5, None, "n")]
    found = ingest.ingest_batch(spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit("p"))).orderBy("arrival").collect()
    assert [r.outcome for r in found] == ["saved", "duplicate", "saved", "stale", "saved"]
    assert ingest.ingest_batch(spark.createDataFrame([], SCHEMA).withColumn("payload", F.lit("p"))).count() == 0


def walk_in_order(batches):
    """The state machine over micro-batches one after the other, each in order of arrival."""
    place = {(k, r[1]): n for n, (k, r) in enumerate(sorted(((k, r) for k, rows in enumerate(batches) for r in rows), key=lambda x: (x[0], x[1][1])))}
    rows = [(r[0], place[k, r[1]], r[2], r[3]) for k, rows in enumerate(batches) for r in rows]
    by_place = {p: (k, a) for (k, a), p in place.items()}
    return {by_place[p]: o for p, o in walk(rows).items()}


def write_events(spark, rows, source):
    spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit("p")).coalesce(1).write.mode("append").parquet(source)


def stream_of(spark, source, **options):
    return spark.readStream.schema(SCHEMA + ", payload string").options(**options).parquet(source)


def test_stream_over_several_micro_batches_and_restarts(spark, tmp_path):
    source, folder = (str(tmp_path / x) for x in ("in", "state"))
    rows = made(5, 160)
    batches = [rows[:50], rows[50:90], rows[90:120], rows[120:]]
    for part in batches[:2]:  # two files are two micro-batches of one run
        write_events(spark, part, source)
        time.sleep(0.02)
    ingest.ingest_available(stream_of(spark, source, maxFilesPerTrigger=1), folder)
    for part in batches[2:]:  # each further run takes up the checkpoint
        write_events(spark, part, source)
        ingest.ingest_available(stream_of(spark, source, maxFilesPerTrigger=1), folder)
    found = {r.arrival: r.outcome for r in ingest.outcomes(spark, folder).collect()}
    assert found == walk(rows) and set(found.values()) == {"saved", "duplicate", "stale"}
    assert spark.read.parquet(f"{folder}/outcomes").select("batch").distinct().count() == 4


def test_events_that_come_late_and_twice(spark, tmp_path):
    """Arrival numbers of later micro-batches may be lower, and a replayed file's events are judged anew: their keys are duplicates."""
    source, folder = (str(tmp_path / x) for x in ("in", "state"))
    rows = made(9, 120)
    batches = [rows[60:], rows[:60], rows[60:]]
    for part in batches:
        write_events(spark, part, source)
        time.sleep(0.02)
        ingest.ingest_available(stream_of(spark, source), folder)
    got = {(k, r.arrival): r.outcome for k, r in enumerate_batches(spark, folder)}
    assert got == walk_in_order(batches)
    assert all(got[2, r[1]] != "saved" for r in rows[60:] if r[3] and got[0, r[1]] == "saved")


def enumerate_batches(spark, folder):
    """The outcomes with the number of their micro-batch among those that had events."""
    rows = spark.read.parquet(f"{folder}/outcomes").collect()
    order = {b: k for k, b in enumerate(sorted({r.batch for r in rows}))}
    return [(order[r.batch], r) for r in rows]


def test_a_micro_batch_that_failed_runs_again(spark, tmp_path, monkeypatch):
    """The sink breaks off between its two tables; the restarted query judges the same events from the same state."""
    source, folder = (str(tmp_path / x) for x in ("in", "state"))
    rows = made(11, 90)
    write_events(spark, rows[:45], source)
    ingest.ingest_available(stream_of(spark, source), folder)
    write_events(spark, rows[45:], source)
    real, calls = ingest._judged, []

    def breaks(*args):
        calls.append(1)
        found = real(*args)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return found

    monkeypatch.setattr(ingest, "_judged", breaks)
    with pytest.raises(Exception, match="lost"):
        ingest.ingest_available(stream_of(spark, source), folder)
    ingest.ingest_available(stream_of(spark, source), folder)
    assert len(calls) == 2 and {r.arrival: r.outcome for r in ingest.outcomes(spark, folder).collect()} == walk(rows)


def test_cost_of_a_micro_batch_does_not_grow_with_history(spark, tmp_path):
    source, folder = (str(tmp_path / x) for x in ("in", "state"))
    sizes = []
    query = None
    for k in range(4):
        write_events(spark, [(f"c{k}-{i}", 1000 * k + i, i, f"k{k}-{i}") for i in range(40)], source)
        query = ingest.ingest_stream(stream_of(spark, source), folder)
        query.processAllAvailable()
        sizes.append(max(p["numInputRows"] for p in query.recentProgress))
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        query.stop()
    assert kept == 4 * 80 * ingest.SALTS, "a state for each conversation and key, and no event"
    assert max(sizes) <= 80 * ingest.SALTS, "the events of one file, or the updates of one batch"


def test_new_files_alone_are_analysed(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    count = lambda rows: rows.select("path", F.length("content").alias("n"))
    for name in ("a", "b"):
        (folder / f"{name}.json").write_text(json.dumps({"x": name}))
        files.analyse_new(spark, str(folder), out, check, count).awaitTermination()
    assert sorted(r.path[-6:] for r in spark.read.parquet(out).collect()) == ["a.json", "b.json"]


def test_shift_in_batches(spark, tmp_path):
    queue = spark.createDataFrame([(i, f"P{i}") for i in range(5)], "idx long, id string")
    take = lambda q: q.orderBy("idx").limit(2)
    state = str(tmp_path / "state")
    assert [[r.id for r in files.shift_in_batches(queue, take, state).collect()] for _ in range(3)] == [["P0", "P1"], ["P2", "P3"], ["P4"]]
    assert spark.read.parquet(state).count() == 5
    status = files.shift_status(spark, state).first()
    assert (status.shifted_count, status.last_shifted_id, status.has_checkpoint, status.checkpoint_valid) == (5, "P4", True, True)
    changed = files.shift_status(spark, state, 123_456).first()
    assert (changed.shifted_count, changed.last_shifted_id, changed.has_checkpoint, changed.checkpoint_valid) == (0, None, True, False)
    assert [r.id for r in files.shift_in_batches(queue, take, state, 123_456).collect()] == ["P0", "P1"]  # another source begins anew
    assert files.shift_status(spark, str(tmp_path / "none")).first().has_checkpoint is False


def test_changed_files_are_analysed_again(spark, tmp_path):
    table = str(tmp_path / "analyses")
    seen = []

    def analyse(rows):
        seen.append(sorted(r.path for r in rows.collect()))
        return rows.select("path", "modified_ms", "size", F.length("content").alias("n"))

    make = lambda rows: spark.createDataFrame(rows, "path string, modified_ms long, size long, content string")
    first = files.reanalyse(make([("a", 1, 1, "x"), ("b", 1, 1, "y")]), table, analyse)
    assert {r.path: r.n for r in first.collect()} == {"a": 1, "b": 1}
    second = files.reanalyse(make([("a", 2, 3, "xyz"), ("b", 1, 1, "y"), ("c", 1, 1, "z")]), table, analyse)
    assert {r.path: r.n for r in second.collect()} == {"a": 3, "b": 1, "c": 1} and seen == [["a", "b"], ["a", "c"]]


def test_questions_stand_once_in_a_batch_and_events_pass_beside_them(spark):
    """A very common conversation asks for its state once for each batch of rows, where each of its events asked before."""
    rows = spark.createDataFrame([("a", i, i, f"k{i % 3}") for i in range(500)] + [(None, 900, None, None)], SCHEMA).withColumn("payload", F.lit("p")).coalesce(1)
    found = ingest._asked(rows).collect()
    asked = sorted((r.kind, r.value or "") for r in found if r.what == "ask")
    assert asked == [("id", ""), ("id", "a"), ("key", "k0"), ("key", "k1"), ("key", "k2")]
    events = [r for r in found if r.what == "event"]
    assert sorted(r.arrival for r in events) == [*range(500), 900] and len({r.salt for r in events}) > 50 and {r.kind for r in events} == {"event"}


def test_a_stream_has_few_tasks_and_known_keys_leave_at_once(spark, tmp_path, monkeypatch):
    """State partitions go by the cores, rounds run where Spark adapts the number of tasks, and events of keys saved before enter no round."""
    source, folder = (str(tmp_path / x) for x in ("in", "state"))
    rows = made(7, 120)
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    judged, stale, adaptive, entered = ingest._judged, ingest._with_stale, [], []
    monkeypatch.setattr(ingest, "_judged", lambda rows, *rest: (adaptive.append(rows.sparkSession.conf.get("spark.sql.adaptive.enabled")), judged(rows, *rest))[1])
    monkeypatch.setattr(ingest, "_with_stale", lambda rows, start: (entered.append({r.arrival for r in rows.select("arrival").collect()}), stale(rows, start))[1])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 48)
        for part in (rows[:90], rows[90:]):
            entered.clear()
            write_events(spark, part, source)
            query = ingest.ingest_stream(stream_of(spark, source), folder)
            query.processAllAvailable()
            states = query.lastProgress["stateOperators"]
            query.stop()
            assert [s["numShufflePartitions"] for s in states] == [8] and spark.conf.get("spark.sql.shuffle.partitions") == "48"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    right = walk(rows)
    assert adaptive == ["true", "true"] and {r.arrival: r.outcome for r in ingest.outcomes(spark, folder).collect()} == right
    known = {r[3] for r in rows[:90] if r[3] and right[r[1]] == "saved"}
    assert entered[0] == {r[1] for r in rows[90:] if r[3] not in known} and len(entered[0]) < 30
