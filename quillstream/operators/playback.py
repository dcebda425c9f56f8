"""Playback: merging validated translations into the corpus.

Candidates: file_order, path, pos, id, text, translator, last_updated_at. Targets: the segment table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .corpus import is_translated, stats
from .running import ranks


def target_states(segments: DataFrame) -> DataFrame:
    """(id, places, full): full says that the id stands once and is translated."""
    grouped = segments.groupBy("id").agg(F.count(F.lit(1)).alias("places"), F.bool_and(is_translated()).alias("all_translated"))
    return grouped.select("id", "places", ((F.col("places") == 1) & F.col("all_translated")).alias("full"))


def classify(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """candidates with state: unknown, already_translated or playable; and nth, a playable's rank of its id."""
    # ranked first: the join then finds the rows dealt by id
    rows = ranks(candidates, ["id"], ["file_order", "pos"], "nth").join(target_states(segments), "id", "left")
    state = F.when(F.col("places").isNull(), "unknown").when(F.col("full"), "already_translated").otherwise("playable")
    rows = rows.withColumn("state", state).drop("places", "full")
    return rows.withColumn("nth", F.when(F.col("state") == "playable", F.col("nth")))


def issue_rows(classified: DataFrame) -> DataFrame:
    """(kind, id, path): each file behind an unknown, already translated or duplicate id, once."""
    twice = classified.where("nth = 2").select("id", F.lit(True).alias("twice"))
    kind = F.when(F.col("state") != "playable", F.col("state")).when(F.col("twice"), "duplicate")
    # a join that splits a very common id, and partial sums before its rows meet
    found = classified.hint("merge").join(twice, "id", "left").withColumn("kind", kind).where("kind is not null")
    return found.select("kind", "id", "path").distinct()


def issues(classified: DataFrame) -> DataFrame:
    """(kind, id, paths): issue_rows() with the files of an id as one text, sorted: for ids of a size to be read."""
    files = classified.groupBy("state", "id", "path").agg(F.max("nth").alias("most")).groupBy("state", "id").agg(F.max("most").alias("most"), F.collect_list("path").alias("paths"))
    kind = F.when(F.col("state") != "playable", F.col("state")).when(F.col("most") > 1, "duplicate")
    # the id has one state
    return files.withColumn("kind", kind).where("kind is not null").select("kind", "id", F.array_join(F.array_sort("paths"), ",").alias("paths"))


_ALT = "array<struct<text:string,translator:int,last_updated_at:bigint>>"


def alternatives(classified: DataFrame) -> DataFrame:
    """(id, position, path, text, translator, last_updated_at): the playable candidates behind the first of their id, in file order, from 1."""
    return classified.where("nth > 1").select("id", (F.col("nth") - 1).alias("position"), "path", "text", "translator", "last_updated_at")


def merge(segments: DataFrame, classified: DataFrame, arrays: bool = True) -> DataFrame:
    """segments with text, translator, last_updated_at of their first playable candidate, and alt with the others added.

    alt is array<struct<text, translator, last_updated_at>> in file order. Without arrays it stays as it is: alternatives() has the others as rows, for
    ids with very many. A corpus with repeated ids stays as it is.
    """
    blocked = segments.groupBy("id").count().where("count > 1").limit(1).agg((F.count(F.lit(1)) > 0).alias("blocked"))
    if arrays:  # the first and the others in one pass over the candidates
        every = F.array_sort(F.collect_list(F.struct("nth", "text", "translator", "last_updated_at")))
        found = classified.where("nth is not null").groupBy("id").agg(every.alias("every"))
        found = found.select("id", F.get("every", F.lit(0)).alias("first"), F.slice("every", F.lit(2), F.size("every")).alias("rest"))
    else:
        found = classified.where("nth = 1").select("id", F.struct("text", "translator", "last_updated_at").alias("first"))
    rows = segments.join(found, "id", "left").join(F.broadcast(blocked))  # one row
    use = F.col("first").isNotNull() & ~F.col("blocked")
    pick = lambda c: F.when(use, F.col(f"first.{c}")).otherwise(F.col(c)).alias(c)
    kept = [c for c in segments.columns if c not in ("text", "translator", "last_updated_at", "alt")]
    none = F.expr(f"cast(array() as {_ALT})")
    old = F.col("alt") if "alt" in segments.columns else none
    alt = F.coalesce(F.transform("rest", lambda x: F.struct(x["text"].alias("text"), x["translator"].alias("translator"), x["last_updated_at"].alias("last_updated_at"))), none) if arrays else none
    return rows.select(*kept, *map(pick, ("text", "translator", "last_updated_at")), F.when(use, F.concat(old, alt)).otherwise(old).alias("alt"))


def counters(classified: DataFrame, many: Column | None = None) -> DataFrame:
    """One row: candidates, applied (with alternatives), unknown, already_translated. many: how many candidates a row stands for, if not one."""
    many = F.lit(1).cast("long") if many is None else many
    n = lambda state: F.coalesce(F.sum(F.when(F.col("state") == state, many)), F.lit(0).cast("long"))
    return classified.agg(F.coalesce(F.sum(many), F.lit(0).cast("long")).alias("candidates"), n("playable").alias("applied"), n("unknown").alias("unknown"), n("already_translated").alias("already_translated"))


def report(segments: DataFrame, classified: DataFrame, files: DataFrame) -> DataFrame:
    """One row on a playback: valid_files and invalid_files of files(path, is_valid), counters() of its candidates, duplicate_ids, whether repeated ids of the corpus
    block it, and stats_before and stats_after of the corpus (corpus.stats()).

    The statistics after it need no merged texts: they follow from which segments get a translation, and whose.
    """
    repeated = segments.groupBy("id").count().where("count > 1").limit(1).agg((F.count(F.lit(1)) > 0).alias("blocked"))
    # a row for each id, written: all that the candidates are read for
    own = materialize(classified.groupBy("id", "state").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("text", "translator"), "nth").alias("first")))
    firsts = own.where("state = 'playable'").select("id", "first")
    after = segments.join(firsts, "id", "left").join(F.broadcast(repeated))  # one row
    use = F.col("first").isNotNull() & ~F.col("blocked")
    after = after.select("collection", *(F.when(use, F.col(f"first.{c}")).otherwise(F.col(c)).alias(c) for c in ("text", "translator")))
    as_struct = lambda rows, name: stats(rows).select(F.struct("*").alias(name))
    checked = files.agg(F.count_if("is_valid").alias("valid_files"), F.count_if(~F.col("is_valid")).alias("invalid_files"))
    twice = own.agg(F.count_if((F.col("state") == "playable") & (F.col("n") > 1)).alias("duplicate_ids"))
    rows = checked
    for one in (counters(own, F.col("n")), twice, repeated, as_struct(segments, "stats_before"), as_struct(after, "stats_after")):
        rows = rows.join(F.broadcast(one))  # one row each
    return rows.withColumn("applied", F.when(F.col("blocked"), 0).otherwise(F.col("applied")))


def provenance(metadata) -> object:
    """The patched struct (applied_at, model, type) of a patch's metadata column; null where its date isn't one."""
    from ..functions.values import iso_seconds

    version, model = metadata["source"]["modelVersion"], metadata["source"]["model"]
    name = F.when(F.coalesce(F.length(version), F.lit(0)) > 0, F.concat(model, F.lit(" ("), version, F.lit(")"))).otherwise(model)
    at = iso_seconds(metadata["appliedAt"])
    return F.when(at.isNotNull(), F.struct(at.alias("applied_at"), name.alias("model"), metadata["source"]["task"].alias("type")))


def save(merged: DataFrame, folder: str, name: str, stamp: str) -> str:
    """Write a new version of the corpus beside the old one; an existing version is never overwritten."""
    path = f"{folder.rstrip('/')}/{name}_new_{stamp.replace(':', '-')}"
    merged.write.mode("errorifexists").partitionBy("collection").parquet(path, compression="zstd")
    return path


def pack(segments: DataFrame, path: str) -> None:
    """Archive a corpus without untranslated segments as compressed Parquet."""
    if not segments.where("text is null").isEmpty():
        raise ValueError("untranslated segments are left")
    segments.write.mode("errorifexists").parquet(path, compression="zstd")
