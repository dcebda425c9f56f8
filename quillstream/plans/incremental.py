"""Corpus statistics over a folder of corpus files, kept file by file: a changed file is read again, and no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..sources.corpus_files import segments_of_pieces
from ..sources.json_items import pieces
from ..streaming.files import changed_files
from .tables import exists, read_version, write_version

_FINGERPRINT = ["path", "modified_ms", "size"]


def file_list(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """(path, modified_ms, size) of the files below a folder; nothing of them is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("path"), F.unix_millis(meta["file_modification_time"].cast("timestamp")).alias("modified_ms"), meta["file_size"].alias("size"))


def kept_facts(spark: SparkSession, folder: str, table: str, glob: str = "*.json") -> DataFrame:
    """corpus.facts() of each file below a folder, with its fingerprint; files that are new or changed since the last call are read, and the table of facts
    is written anew without those that are gone or changed. Facts are small beside their files. The names of changed files pass the driver.
    """
    now = file_list(spark, folder, glob)
    known = read_version(spark, table) if exists(spark, table) else None
    fresh = [r["path"] for r in (now if known is None else changed_files(now, known)).select("path").collect()]
    valid = None if known is None else known.join(now, _FINGERPRINT, "left_semi")
    if not fresh and known is not None and changed_files(known.select(*_FINGERPRINT).distinct(), now).isEmpty():
        return known
    if fresh:
        made = corpus.facts(segments_of_pieces(pieces(spark, fresh, glob)), "path").hint("merge").join(now, "path")
        # a file without a segment is known, too
        made = made.unionByName(now.where(F.col("path").isin(fresh)).withColumn("weight", F.lit(0).cast("long")), allowMissingColumns=True)
        valid = made if valid is None else valid.unionByName(made)
    if valid is not None:
        write_version(valid, table)
    return read_version(spark, table) if valid is not None else corpus.facts(segments_of_pieces(pieces(spark, folder, glob)))


def merged(kept: DataFrame) -> DataFrame:
    """The facts of all files together, which the statistics in operators.corpus take."""
    return corpus.facts(kept.where("weight > 0"))
