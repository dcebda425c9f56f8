"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage takes any documents table: rows of null or wordless text have no language and go in the first stage, an
empty table stays empty, and further columns aren't read. Rows without a doc_id are documents of their own in all stages:
they are never earlier or later than others in line dedup, linked with nothing in near-dedup, and have their share in the
mix. Rows of one doc_id and different texts are told apart throughout; of wholly repeated rows near-dedup keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontam, langid, line_dedup, mixing, neardup
from quillstream.llm.common import scratch, stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less certain than this is rejected.
MIN_LANGUAGE_SCORE = 0.5
#: Words of a shingle in the near-dedup stage: those of op5's contract.
SHINGLE = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or of no certain language, go."""
    found = langid.identify_by_own_labels(docs, keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that earlier ones have; those that lose every word go."""
    found = line_dedup.deduplicate_lines(docs, rare_share=None, keep=("lang", "source", "n_chars"))
    changed = F.size("removed_lines") > 0
    found = found.where(~changed | F.col("clean_text").rlike(line_dedup.WORD))
    n_chars = F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, in the sense of op5: of the smallest doc_id. Of repeated rows one
    stays; of rows of one doc_id and different texts, each is a document. Rows without a doc_id all stay."""
    rows = stash(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    # rows are compared under their own numbers, so that those of one doc_id are told apart
    numbered = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")
    found = neardup.near_duplicates(numbered, SHINGLE).where("doc_id <> component_id")
    found = stash(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "linked")
    linked = found.union(found.select(F.col("group").alias("row"), "group").distinct())
    linked = stash(linked.hint("merge").join(rows.select("row", "doc_id"), "row"), "groups")
    first = linked.groupBy("group").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    gone = linked.select("row").hint("merge").join(first.hint("merge"), "row", "left_anti")
    return rows.hint("merge").join(gone, "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't fill to a twentieth."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return decontam.digest(found).where("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the words that a mix of target weights takes of each (0: the mix leaves it out)."""
    _, found = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return found.select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: SQL can't express patience alignment or the language model: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
