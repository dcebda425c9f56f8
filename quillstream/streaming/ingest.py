"""Keyed ingest: duplicates by key are answered, stale sequence numbers skipped, all else saved, in order of arrival.

Events: id, seq (null: no order is asked for), key (null: no check), payload, arrival. The checks are one state
machine in this order: a key that was saved before, in any conversation, is a duplicate; a seq that isn't above the
saved one is stale, and leaves no key; else the payload is saved with its seq, null or not.

Keys tie all conversations together, so the events can't be dealt out and walked. A table, or a micro-batch, is settled in
rounds of joins: given what is known of duplicates, each conversation's saved numbers follow by running maxima; given
these, each key belongs to its first event that isn't stale, and what comes after that one is a duplicate. After a round
the events that nothing unsettled precedes, in their conversation or under their key, are done and leave, and so are those of
a key that is saved for certain; rounds end when nothing changes among the rest.

A stream keeps what was saved, a number for each conversation and a flag for each key, as a streaming aggregate in a state store. A
micro-batch asks only for the state of its own conversations and keys, so its cost doesn't grow with what came before. What it saves
comes back to the state as input of the next micro-batch, from a folder of updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.tables import exists, make_folder, materialize, shared_folder

#: Events of a conversation whose running maximum one task works out; those of a longer one are cut into ranges of arrival.
CHUNK = 65_536
#: Copies of each state. One is enough: events pass beside the state, and a very common conversation or key is asked for once by each task.
SALTS = 1
#: Groups in which a micro-batch's events are dealt over the tasks, beside the state.
DEALT = 256


def prepared(events: DataFrame) -> DataFrame:
    """events in the operator's columns. A null id is a conversation like any other. arrival is a whole number, unique and about dense."""
    return events.select(
        F.col("id").cast("string").alias("id"), F.col("arrival").cast("long").alias("arrival"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"),
        F.sha2(F.col("payload").cast("string"), 256).alias("payload_sha256"),
    )


def _with_stale(rows: DataFrame, start: DataFrame) -> DataFrame:
    """rows(id, arrival, seq, dup, sure) with stale: whether the event, if its key is new, is at or below what its conversation saved last;
    and settled instead of sure: whether it and all before it in its conversation are sure.

    What is saved last is the highest number since the last event without one that is no duplicate: stale numbers are
    never above it. start(id, saved) is what each conversation saved before. Maxima are taken within chunks of arrivals
    and then over the chunks, so a very long conversation is no task's alone.
    """
    own = ["conversation", "chunk"]
    rows = rows.withColumns({"conversation": F.coalesce(F.concat(F.lit("="), F.col("id")), F.lit("")), "chunk": F.floor(F.col("arrival") / CHUNK)})
    live = rows.withColumns({"reset": ~F.col("dup") & F.col("seq").isNull(), "live": F.when(~F.col("dup"), F.col("seq"))})
    resets = F.sum(F.col("reset").cast("int")).over(Window.partitionBy(*own).orderBy("arrival"))
    live = live.withColumn("since", resets)
    before = Window.partitionBy(*own, "since").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("inside", F.max("live").over(before))

    # what each chunk hands on: its maximum since its last reset, and whether it had one; and its first event that is unsure
    runs = live.groupBy(*own, "since").agg(F.max("live").alias("most"), F.min(F.when(~F.col("sure"), F.col("arrival"))).alias("doubt"))
    chunks = runs.groupBy(*own).agg(F.max("since").alias("resets"), F.max_by("most", "since").alias("most"), F.min("doubt").alias("doubt"))
    chunks = chunks.withColumn("segment", F.sum((F.col("resets") > 0).cast("int")).over(Window.partitionBy("conversation").orderBy("chunk")))
    chunks = chunks.withColumn("out", F.max("most").over(Window.partitionBy("conversation", "segment").orderBy("chunk")))
    earlier = Window.partitionBy("conversation").orderBy("chunk")
    doubt = F.min("doubt").over(Window.partitionBy("conversation"))
    chunks = chunks.select(*own, F.lag("out").over(earlier).alias("carried"), (F.coalesce(F.lag("segment").over(earlier), F.lit(0)) == 0).alias("fresh"), doubt.alias("doubt"))
    begun = start.select(F.coalesce(F.concat(F.lit("="), F.col("id")), F.lit("")).alias("conversation"), "saved")
    chunks = chunks.join(begun, "conversation", "left").select(*own, F.when(F.col("fresh"), F.greatest("carried", "saved")).otherwise(F.col("carried")).alias("carried"), "doubt")
    rows = live.hint("merge").join(chunks, own)
    last = F.when(F.col("since") == 0, F.greatest("inside", "carried")).otherwise(F.col("inside"))
    settled = F.col("sure") & F.coalesce(F.col("arrival") <= F.col("doubt"), F.lit(True))
    # an event without a number is itself the first of its run and never stale
    rows = rows.withColumns({"stale": F.coalesce(F.col("seq") <= last, F.lit(False)), "settled": settled})
    return rows.drop("conversation", "chunk", "reset", "live", "since", "inside", "carried", "doubt", "sure")


def ingest_batch(events: DataFrame, keys: DataFrame | None = None, saved_before: DataFrame | None = None) -> DataFrame:
    """(id, arrival, seq, key, payload_sha256, outcome) of every event of a table: saved, duplicate or stale.

    keys(key) and saved_before(id, seq) are what was saved earlier. Every round writes the events that are still unsettled
    to the shared folder, once.
    """
    none = lambda schema: events.sparkSession.createDataFrame([], schema)
    return _judged(prepared(events), none("key string") if keys is None else keys, none("id string, seq long") if saved_before is None else saved_before)


def _judged(rows: DataFrame, keys: DataFrame, saved_before: DataFrame) -> DataFrame:
    """The outcomes of prepared events."""
    keys = keys.select("key").distinct()
    start = saved_before.select("id", F.col("seq").alias("saved"))
    own = ["id", "arrival", "seq", "key", "payload_sha256"]
    rows = rows.select(*own).hint("merge").join(keys.withColumn("known", F.lit(True)), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = materialize(rows)
    # an event of a known key is a duplicate, whatever comes before it, and bears on no other
    done = [rows.where("known").select(*own, F.lit("duplicate").alias("outcome"))]
    rows = rows.where("not known").select(*own, F.lit(False).alias("dup"))
    outcome = F.when(F.col("dup"), "duplicate").when(F.col("stale"), "stale").otherwise("saved").alias("outcome")
    while True:
        # an event that no other unsettled one of its key precedes is no duplicate
        lead = rows.where("key is not null").groupBy("key").agg(F.min("arrival").alias("lead"))
        rows = rows.hint("merge").join(lead, "key", "left").withColumn("sure", F.coalesce(F.col("arrival") == F.col("lead"), F.lit(True))).drop("lead")
        # of a conversation, all before the first event that is unsure have their last word
        judged = materialize(_with_stale(rows, start))
        done.append(judged.where("settled").select(*own, outcome))
        if judged.where("not settled").isEmpty():
            break
        # partial minima first, so that a very common key is no task's alone
        first = judged.where("key is not null and not stale").groupBy("key").agg(F.min("arrival").alias("first"), F.min_by("settled", "arrival").alias("claimed"))
        left = judged.where("not settled").hint("merge").join(first, "key", "left")
        later = F.coalesce(F.col("arrival") > F.col("first"), F.lit(False))
        left = materialize(left.select(*own, later.alias("dup"), (later & F.col("claimed")).alias("known"), (later != F.col("dup")).alias("moved"), "stale"))
        if left.where("moved").isEmpty():
            done.append(left.select(*own, outcome))
            break
        done.append(left.where("known").select(*own, F.lit("duplicate").alias("outcome")))
        start = _newest(start, judged.where("settled and not dup and not stale").groupBy("id").agg(F.max_by("seq", "arrival").alias("saved")))
        rows = left.where("not known").select(*own, "dup")
    while len(done) > 1:
        done = [a.union(b) for a, b in zip(done[::2], done[1::2])] + done[len(done) - len(done) % 2 :]
    return done[0]


def _newest(start: DataFrame, saved: DataFrame) -> DataFrame:
    """start(id, saved) with the conversations of saved replaced."""
    rows = start.withColumn("place", F.lit(0)).union(saved.withColumn("place", F.lit(1)))
    return materialize(rows.groupBy("id").agg(F.max_by("saved", "place").alias("saved")))


_UPDATE = "kind string, value string, seq long, batch long"
_EVENT = {"id": "string", "arrival": "long", "key": "string", "payload_sha256": "string"}


def _asked(events: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Every event, and beside them a row for each conversation and key that they ask for: its state, or ask where nothing is saved.

    updates(kind, value, seq, batch) are what was saved (of a batch: the last counts). Of a stream the aggregate holds all that came
    before, and gives the states of a micro-batch's conversations and keys alone. Tasks ask for each once, and nothing of an event is kept.
    """
    rows, null = prepared(events), lambda kind, name: F.lit(None).cast(kind).alias(name)
    salt = F.pmod(F.xxhash64("arrival"), F.lit(DEALT)).alias("salt")
    passed = rows.select(F.lit("event").alias("what"), F.lit("event").alias("kind"), null("string", "value"), salt, "seq", null("long", "batch"), *_EVENT).repartition("salt")
    ask = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"), null("long", "seq"), null("long", "batch"))
    kept = rows.select(F.explode(F.array(ask("id", "id"), ask("key", "key"))).alias("row")).select("row.*").where("kind = 'id' or value is not null")
    if updates is not None:
        kept = kept.union(updates.select(*kept.columns))
    kept = kept.groupBy("kind", "value").agg(F.max_by("seq", "batch").alias("seq"), F.max("batch").alias("batch"))
    what = F.when(F.col("batch").isNull(), "ask").otherwise("state").alias("what")
    return passed.union(kept.select(what, "kind", "value", F.lit(0).cast("long").alias("salt"), "seq", "batch", *(null(t, c) for c, t in _EVENT.items())))


def ingest_stream(events: DataFrame, folder: str, every: str = "0 seconds", partitions: int | None = None) -> StreamingQuery:
    """The same over a stream, micro-batch by micro-batch: outcomes are a table below folder, a part for each micro-batch.

    A micro-batch's events are judged in order of arrival, after all of earlier micro-batches, whatever their numbers. One that runs
    again after a failure reads the same events and the same state, and overwrites its part. The source's own
    options bound a micro-batch (maxFilesPerTrigger, maxBytesPerTrigger); the query looks for new events at the interval `every`
    until it is stopped (ingest_available() ends by itself). The state is in RocksDB state stores, with the checkpoint below folder.
    Each of its partitions is opened and written in every micro-batch: a first start makes two for each core, or as many as a shuffle
    has where that is less, or `partitions`; later ones keep these.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", True)
    make_folder(spark, f"{folder}/updates")
    # read without a bound, so that a micro-batch has all updates of those before it; files go when they are in the state
    updates = spark.readStream.schema(_UPDATE).option("recursiveFileLookup", True).option("cleanSource", "delete").parquet(f"{folder}/updates")
    told = _asked(events, updates)

    def batch(told: DataFrame, number: int) -> None:
        path = shared_folder(spark)
        told.write.parquet(path)  # once: reading it works the state
        # the rounds run in the session of the caller: that of the stream doesn't adapt the number of tasks to what they have
        told = spark.read.schema(told.schema).parquet(path)
        rows = told.where("what = 'event'")
        if rows.isEmpty():
            return
        state = told.where("what = 'state'").select("kind", "value", "seq")
        keys, seqs = state.where("kind = 'key'").select(F.col("value").alias("key")), state.where("kind = 'id'").select(F.col("value").alias("id"), "seq")
        done = materialize(_judged(rows, keys, seqs), f"{folder}/outcomes/batch={number}", "overwrite")
        new = done.where("outcome = 'saved'")
        by_id = new.groupBy("id").agg(F.max_by("seq", "arrival").alias("seq")).select(F.lit("id").alias("kind"), F.col("id").alias("value"), "seq")
        by_key = new.where("key is not null").select(F.lit("key").alias("kind"), F.col("key").alias("value"), F.lit(None).cast("long").alias("seq"))
        by_id.union(by_key).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/updates/{number:012d}")

    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions or min(int(shuffle), 2 * spark.sparkContext.defaultParallelism))
    try:  # the stream's session is a copy of this one, made at the start
        return told.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def ingest_available(events: DataFrame, folder: str) -> None:
    """ingest_stream() over the events there are now."""
    query = ingest_stream(events, folder)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The outcomes of all batches of a stream."""
    schema = "id string, arrival long, seq long, key string, payload_sha256 string, outcome string"
    return spark.read.schema(schema).parquet(f"{folder}/outcomes").drop("batch") if exists(spark, f"{folder}/outcomes") else spark.createDataFrame([], schema)


def saved(outcomes: DataFrame) -> DataFrame:
    """(id, seq, payload_sha256) of what is stored in the end: the last saved write of each conversation."""
    rows = outcomes.where("outcome = 'saved'").groupBy("id").agg(F.max_by(F.struct("seq", "payload_sha256"), "arrival").alias("last"))
    return rows.select("id", "last.seq", "last.payload_sha256")


def first_by_key(events: DataFrame) -> DataFrame:
    """(key, id, arrival): the first event of each key."""
    return events.where("key is not null").groupBy("key").agg(F.min_by(F.struct("id", "arrival"), "arrival").alias("first")).select("key", "first.id", "first.arrival")


def latest_by_seq(events: DataFrame) -> DataFrame:
    """(id, seq, arrival) where every event has a seq: the highest, the first of it to arrive."""
    rows = events.groupBy("id").agg(F.max_by(F.struct("seq", "arrival"), F.struct(F.col("seq"), (-F.col("arrival")).alias("a"))).alias("last"))
    return rows.select("id", "last.seq", "last.arrival")
