"""Incremental analysis: new conversation files of a folder, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.tables import exists, materialize


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified_ms, content) of files, each once; Spark's checkpoint remembers which were read."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema("value string").load(folder)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), F.unix_millis(meta["file_modification_time"].cast("timestamp")).alias("modified_ms"), F.col("value").alias("content"))


def analyse_new(spark: SparkSession, folder: str, out: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run analyse() over the files that came since the last run, and append its rows to out."""
    return analyse(stream_files(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The version of the checkpoint's tables.
VERSION = 1


def shift_in_batches(queue: DataFrame, take: Callable[[DataFrame], DataFrame], state: str, source_mtime_ms: int | None = None) -> DataFrame:
    """The next batch of a work queue, whose ids are appended to the state table before it is handed out.

    The state is of one version of the source: at another time of its last change (whole milliseconds) it begins anew.
    """
    spark = queue.sparkSession
    now = None if source_mtime_ms is None else int(source_mtime_ms)
    done = _shifted(spark, state).where(F.col("version") == VERSION).where(F.col("source_mtime_ms").eqNullSafe(F.lit(now).cast("long")))
    left = queue.join(done.select("id").distinct(), "id", "left_anti").select(*queue.columns)
    batch = materialize(take(left))
    number = (done.agg(F.max("batch")).first()[0] or 0) + 1
    keys = [c for c in ("collection_order", "idx") if c in batch.columns] or ["id"]
    batch.select(
        "id", F.lit(number).cast("long").alias("batch"), F.to_json(F.struct(*(F.format_string("%020d", c) if c == "idx" else F.col(c).cast("string") for c in keys))).alias("place"),
        F.lit(now).cast("long").alias("source_mtime_ms"), F.lit(VERSION).alias("version"),
    ).write.mode("append").parquet(state)
    return batch


def shift_status(spark: SparkSession, state: str, source_mtime_ms: int | None = None) -> DataFrame:
    """One row on the checkpoint: source_mtime_ms, checkpoint_mtime_ms, shifted_count, last_shifted_id, has_checkpoint, checkpoint_valid. Only a valid one counts as shifted."""
    rows = _shifted(spark, state)
    now = F.lit(None if source_mtime_ms is None else int(source_mtime_ms)).cast("long")
    valid = (F.col("version") == VERSION) & F.col("source_mtime_ms").eqNullSafe(now)
    found = rows.agg(
        F.max("source_mtime_ms").alias("checkpoint_mtime_ms"), F.count_if(valid).alias("shifted_count"), F.max_by("id", F.when(valid, F.struct("batch", "place"))).alias("last_shifted_id"),
        (F.count(F.lit(1)) > 0).alias("has_checkpoint"), F.coalesce(F.bool_or(valid), F.lit(False)).alias("checkpoint_valid"),
    )
    return found.select(now.alias("source_mtime_ms"), "*")


def _shifted(spark: SparkSession, state: str) -> DataFrame:
    schema = "id string, batch long, place string, source_mtime_ms long, version int"
    return spark.read.schema(schema).parquet(state) if exists(spark, state) else spark.createDataFrame([], schema)


def changed_files(files: DataFrame, analysed: DataFrame) -> DataFrame:
    """Of files(path, modified_ms, size, ...), those that analysed doesn't hold as they are now: new and changed ones."""
    return files.join(analysed.select("path", "modified_ms", "size").distinct(), ["path", "modified_ms", "size"], "left_anti").select(*files.columns)


def reanalyse(files: DataFrame, table: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The analyses of files(path, modified_ms, size, content): those in the table at that path that still hold, and analyse() of new and changed files, which are appended.

    analyse() keeps path, modified_ms and size.
    """
    spark = files.sparkSession
    known = spark.read.parquet(table) if exists(spark, table) else None
    fresh = files if known is None else changed_files(files, known)
    analyse(fresh).write.mode("append").parquet(table)
    return spark.read.parquet(table).join(files.select("path", "modified_ms", "size"), ["path", "modified_ms", "size"], "left_semi")
