"""Statistics and filters over the analysed files: path, model, is_valid, patches_applied, thinking_sec."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import thinking_bucket


def stats(files: DataFrame) -> DataFrame:
    """One row: total, valid and invalid files, and the patches applied."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("is_valid").alias("valid_files"), F.count_if(~F.col("is_valid")).alias("invalid_files"),
        F.coalesce(F.sum("patches_applied"), F.lit(0)).cast("long").alias("patches_applied"),
    )


def by_model(files: DataFrame) -> DataFrame:
    """(model, files, invalid). Files without a model are counted as `unknown` where they are invalid, and nowhere else."""
    model = F.nullif("model", F.lit(""))
    rows = files.where(model.isNotNull() | ~F.col("is_valid")).groupBy(F.coalesce(model, F.lit("unknown")).alias("model"))
    return rows.agg(F.count_if(model.isNotNull()).alias("files"), F.count_if(~F.col("is_valid")).alias("invalid"))


def thinking_times(files: DataFrame) -> DataFrame:
    return files.withColumn("bucket", thinking_bucket(F.col("thinking_sec"))).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("files"))


def matching(files: DataFrame, model: str = "all", status: str = "all", thinking_time: str = "all") -> DataFrame:
    """The files that pass every filter that isn't `all`."""
    rows = files
    if model != "all":
        rows = rows.where(F.col("model") == model)
    if status != "all":
        rows = rows.where(F.col("is_valid") == (status == "valid"))
    if thinking_time != "all":
        rows = rows.where(thinking_bucket(F.col("thinking_sec")) == thinking_time)
    return rows


# fixed values: the filters' own words
STATUSES, THINKING_TIMES = ("all", "valid", "invalid"), ("all", "lt_10s", "10_to_30s", "30_to_60s", "1m_plus")


def filters(given: Mapping[str, str | None], saved: Mapping[str, str | None] | None = None) -> dict[str, str]:
    """model, status and thinking_time for matching(): what is given, else what was saved; blanks and words that aren't known count as `all`."""
    merged = {k: str(given.get(k) or (saved or {}).get(k) or "all").strip() or "all" for k in ("model", "status", "thinking_time")}
    for key, known in (("status", STATUSES), ("thinking_time", THINKING_TIMES)):
        merged[key] = merged[key] if merged[key] in known else "all"
    return merged


def folders(path: Column) -> Column:
    """All folders above a file, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), i), "/")))


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, name, kind, depth, files): the folders that hold a file, with their files' number, and the files."""
    above = files.select(F.explode(folders(F.col("path"))).alias("path")).where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("files"))
    rows = above.withColumn("kind", F.lit("directory")).unionByName(files.select("path", F.lit(1).cast("long").alias("files"), F.lit("file").alias("kind")))
    parts = F.split("path", "/")
    parent = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return rows.select("path", parent.alias("parent"), F.element_at(parts, -1).alias("name"), "kind", F.size(parts).alias("depth"), "files")


def is_safe(path: str) -> bool:
    """Whether a relative path stays below its root."""
    return bool(path.strip()) and not path.startswith(("/", "\\")) and ".." not in path.replace("\\", "/").split("/")


def without(files: DataFrame, paths: list[str]) -> DataFrame:
    """files without the given ones; unsafe paths raise an error."""
    if bad := [p for p in paths if not is_safe(p)]:
        raise ValueError(f"Invalid file path: {bad[0]}")
    gone = files.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    return files.join(gone, "path", "left_anti")


def unchanged(files: DataFrame, analysed: DataFrame) -> DataFrame:
    """The files whose (path, modified_ms, size) was analysed before: the rest must be analysed again."""
    return files.join(analysed.select("path", "modified_ms", "size").distinct(), ["path", "modified_ms", "size"], "left_semi")
