"""Corpus files (one large JSON object each), prompt files, and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import COLLECTIONS
from .json_items import items, members, pieces

_ITEM = """struct<id:string,`from`:int,`to`:int,nass:string,text:string,translator:int,lastUpdatedAt:bigint,parent:string,
 meta:struct<alt:array<struct<text:string,translator:int,lastUpdatedAt:bigint>>,num:string,type:string,patched:struct<appliedAt:bigint,model:string,type:string>>>"""
SCHEMA = f"createdAt bigint, lastUpdatedAt bigint, promptForTranslation string, promptId string, {', '.join(f'{c} array<{_ITEM}>' for c in COLLECTIONS)}"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus file as one row, by one task: for small files. read_segments() and read_meta() split a file of any size."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def segments(corpus: DataFrame) -> DataFrame:
    """The segment table: collection, idx, id, nass, text, translator, last_updated_at, alt, alt_count, patch_type, parent, from, to."""
    parts = [corpus.select(F.lit(c).alias("collection"), F.posexplode(c).alias("idx", "s")) for c in COLLECTIONS]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _segment_columns(rows)


def read_segments(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """segments() of the corpus file at a path, or of all below it, by as many tasks as there are splits."""
    return segments_of_pieces(pieces(spark, path), parts).drop("path")


def segments_of_pieces(found: DataFrame, parts: int | None = None) -> DataFrame:
    """The segment table of json_items.pieces(), with the path of each segment's file."""
    rows = items(found, parts).where(F.col("collection").isin(*COLLECTIONS))
    return _segment_columns(rows.select("path", "collection", F.col("idx").cast("int").alias("idx"), F.from_json("json", _ITEM).alias("s")), "path")


def read_meta(spark: SparkSession, path: str, parts: int | None = None, glob: str = "*.json") -> DataFrame:
    """meta() of the corpus file at a path, by as many tasks as there are splits."""
    found = members(pieces(spark, path, glob), parts).select("path", F.from_json("json", SCHEMA).alias("m")).select("path", "m.*")
    # each member stands in one run
    names = ("createdAt", "lastUpdatedAt", "promptForTranslation", "promptId")
    return meta(found.groupBy("path").agg(*(F.max(n).alias(n) for n in names)))


def _segment_columns(rows: DataFrame, *more: str) -> DataFrame:
    s = F.col("s")
    alt = F.transform(s["meta"]["alt"], lambda a: F.struct(a["text"].alias("text"), a["translator"].alias("translator"), a["lastUpdatedAt"].alias("last_updated_at")))
    return rows.select(
        *more, "collection", "idx", s["id"].alias("id"), s["nass"].alias("nass"), s["text"].alias("text"), s["translator"].alias("translator"), s["lastUpdatedAt"].alias("last_updated_at"),
        F.coalesce(alt, F.expr("cast(array() as array<struct<text:string,translator:int,last_updated_at:bigint>>)")).alias("alt"),
        F.greatest(F.coalesce(F.size(s["meta"]["alt"]), F.lit(0)), F.lit(0)).alias("alt_count"), s["meta"]["patched"]["type"].alias("patch_type"), s["parent"].alias("parent"), s["from"].alias("from"), s["to"].alias("to"),
    )


def meta(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("createdAt").alias("created_at"), F.col("lastUpdatedAt").alias("last_updated_at"), F.col("promptForTranslation").alias("prompt"), F.col("promptId").alias("prompt_id"))


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, content, is_master) of the Markdown files of a folder, to the last line break: a prompt may be chosen by its content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    key = F.translate(F.upper(stem), "-", "_")
    return rows.select(key.alias("id"), F.initcap(F.translate(F.lower(key), "_", " ")).alias("name"), F.decode("content", "UTF-8").alias("content"), (stem == "master").alias("is_master"))


def compose_prompt(master: Column, addon: Column) -> Column:
    from ..functions.text import trim

    return F.concat(trim(master), F.lit("\n"), trim(addon))


def select_prompt(prompts: DataFrame, saved_id: str | None = None, saved_content: str | None = None) -> DataFrame:
    """The one prompt that is saved: by id, else by content, else the first that isn't the master."""
    order = F.when(F.col("id") == F.lit(saved_id), 0).when(F.col("content") == F.lit(saved_content), 1).when(~F.col("is_master"), 2).otherwise(3)
    return prompts.orderBy(order, "id").limit(1)


def with_prompt(corpus_meta: DataFrame, prompt_id: str, content: str, now: int) -> DataFrame:
    """meta() with another prompt, stamped in epoch seconds."""
    return corpus_meta.withColumns({"prompt": F.lit(content), "prompt_id": F.lit(prompt_id), "last_updated_at": F.lit(now).cast("long")})
