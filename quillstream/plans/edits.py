"""Writing edits: patches and skips of single excerpts, merged into the edits that conversations carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.patches import OPS, clean_skips

_EDITS = f"patches map<string,struct<ops:{OPS}>>, patchMetadata map<string,variant>, skip array<string>"


def apply_changes(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """conversations(path, edits, known) with edits after changes(path, id, ops, metadata, skip).

    ops: the excerpt's new patch, an empty array to drop it, null to leave it; metadata (JSON) goes with the patch.
    skip: true or false to put the excerpt on the skip list or take it off, null to leave it. known is the array of the
    conversation's excerpt ids: skips of others go. Metadata without a patch goes, and what is empty is left out. Of
    several changes to one excerpt none is preferred: hand over one. Conversations without changes stay as they are.
    """
    each = F.struct("id", "ops", "metadata", "skip")
    changed = changes.groupBy("path").agg(F.collect_list(each).alias("c"))  # as many as the file's excerpts
    rows = conversations.join(changed, "path", "left").withColumn("e", F.from_json("edits", _EDITS))
    ids = lambda cond: F.transform(F.filter("c", cond), lambda c: c["id"])
    rows = rows.withColumns({"touched": ids(lambda c: c["ops"].isNotNull()), "on": ids(lambda c: c["skip"]), "off": ids(lambda c: ~c["skip"])})
    fresh = F.map_from_entries(F.transform(F.filter("c", lambda c: F.size(c["ops"]) > 0), lambda c: F.struct(c["id"], F.struct(c["ops"].alias("ops")))))
    notes = F.map_from_entries(F.transform(F.filter("c", lambda c: (F.size(c["ops"]) > 0) & c["metadata"].isNotNull()), lambda c: F.struct(c["id"], F.try_parse_json(c["metadata"]))))
    old = lambda field, kind: F.map_filter(F.coalesce(F.col(f"e.{field}"), F.expr(f"cast(map() as {kind})")), lambda k, v: ~F.array_contains("touched", k))
    rows = rows.withColumn("p", F.map_concat(old("patches", f"map<string,struct<ops:{OPS}>>"), fresh))
    rows = rows.withColumn("m", F.map_filter(F.map_concat(old("patchMetadata", "map<string,variant>"), notes), lambda k, v: F.map_contains_key("p", k)))
    kept = F.filter(clean_skips(F.col("e.skip")), lambda x: F.array_contains("known", x) & ~F.array_contains("off", x))
    rows = rows.withColumn("s", F.array_sort(F.array_union(kept, F.filter("on", lambda x: F.array_contains("known", x)))))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    packed = F.to_json(F.struct(some("p").alias("patches"), some("m").alias("patchMetadata"), some("s").alias("skip")))
    new = F.when(F.col("c").isNull(), F.col("edits")).otherwise(F.nullif(packed, F.lit("{}")))
    return rows.select(*(new.alias("edits") if c == "edits" else c for c in conversations.columns))
