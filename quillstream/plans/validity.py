"""From conversations to file analyses: segment, align, patch, validate, and roll errors up.

Conversations come from sources.conversations.to_common(). The response that is validated is the one rebuilt in
source order, with missing translations as ''; validate_raw() looks at the response as it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import find, index, let, places
from ..functions.text import normalize, segments, serialize, trim
from ..functions.values import iso_seconds, translator_id
from ..operators.alignment import align, alignment_errors, first_out_of_order, ids
from ..operators.patches import OPS, apply_to_segments, checked, clean_skips, legacy_patches
from ..operators.patches import metadata as patch_metadata
from ..operators.rules import Config, validate

_RANGE = "struct<start:int,end:int>"
EDITS = "patches map<string,variant>, skip array<string>, patchMetadata map<string,variant>"
_ERROR = "struct<rule:string,type:string,message:string,match:string,start:int,end:int,id:string,segment_start:int,segment_end:int>"


def _ids_of(parsed: Column) -> Column:
    return index(F.transform(parsed, lambda s: s["id"]))


def _text_of(parsed: Column, indexed: Column, name: Column, last: bool) -> Column:
    """The text of an id in parsed, whose ids are indexed."""
    return F.get(parsed, find(indexed, name, last))["text"]


def segment_pairs(conversations: DataFrame) -> DataFrame:
    """conversations with segments (of the response), source (of the prompt, aligned) and aligned."""
    rows = conversations.withColumn("segments", segments(normalize(F.coalesce("response", F.lit("")))))
    rows = rows.withColumn("prompt_segments", segments(normalize(trim(F.coalesce("prompt", F.lit(""))))))
    return align(rows).drop("prompt_segments")


def _with_errors(rows: DataFrame, response: str, config: Config) -> DataFrame:
    """rows(source, response) with errors: the rules' and then the alignment's."""
    rows = validate(rows.drop("segments"), response=response, source="source", config=config)
    # each step is a column of its own, so that no expression holds copies of another
    rows = rows.withColumns({"_expected": ids(F.col("source")), "_got": ids(F.col("segments"))})
    rows = rows.withColumn("_odd", first_out_of_order(F.col("_expected"), F.col("_got")))
    extra = F.transform(alignment_errors(F.col("_expected"), F.col("_got"), F.col("_odd")), lambda e: F.struct(
        e["type"].alias("rule"), e["type"].alias("type"), e["message"].alias("message"), e["match"].alias("match"), F.lit(0).alias("start"), F.length(response).alias("end"),
        e["id"].alias("id"), F.lit(None).cast("int").alias("segment_start"), F.lit(None).cast("int").alias("segment_end"),
    ).cast(_ERROR))
    return rows.withColumn("errors", F.concat(F.transform("errors", lambda e: e.cast(_ERROR)), extra)).drop("_expected", "_got", "_odd")


def validate_raw(conversations: DataFrame, config: Config = Config()) -> DataFrame:
    """conversations with source and errors of the response as it was written."""
    rows = segment_pairs(conversations).withColumn("_response", F.coalesce("response", F.lit("")))
    return _with_errors(rows, "_response", config).drop("_response", "normalized")


def analyse(conversations: DataFrame, config: Config = Config()) -> DataFrame:
    """conversations with patches_applied, errors, visible_errors, is_valid, playable, and the texts by id.

    Patched and skipped excerpts hide their errors. playable is array<struct<pos, id, nass, text, translator,
    last_updated_at>>, empty where any error exists, hidden or not. A model that stands for no translator is an
    error of the file, unless it is invalid already. Files that couldn't be read keep their error and are invalid.
    Write the result (tables.materialize) before filtering it.
    """
    rows = segment_pairs(conversations.withColumnRenamed("error", "_error")).withColumn("_edits", F.from_json("edits", EDITS))
    skips = clean_skips(F.col("_edits.skip"))
    rows = rows.withColumn("skips", F.array_distinct(skips))
    rows = rows.withColumn("_own", _ids_of(F.col("segments")))
    base = F.transform("source", lambda s: F.struct(s["id"].alias("id"), F.coalesce(_text_of(F.col("segments"), F.col("_own"), s["id"], True), F.lit("")).alias("text")))
    rows = rows.withColumn("_base", base).withColumn("base_texts", F.col("segments"))
    rows = rows.withColumns({"_keys": index(F.map_keys("_edits.patches")), "_values": F.map_values("_edits.patches"), "_skipped": index(F.col("skips")), "_places": _ids_of(F.col("_base"))})
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    own = lambda s: F.get(F.col("_values"), find(F.col("_keys"), s["id"]))
    ops = lambda s: F.when(kind(own(s)).startswith("OBJECT"), checked(F.from_json(F.to_json(F.struct(own(s).alias("p"))), f"p struct<ops:{OPS}>")["p"]["ops"]))
    rows = rows.withColumn("_each", F.transform("_base", lambda s: F.struct(s["id"].alias("id"), ops(s).alias("ops"))))
    rows = rows.withColumn("_found", F.filter("_each", lambda x, i: x["ops"].isNotNull() & (find(F.col("_places"), x["id"]) == i)))
    rows = _legacy(rows, kind)
    rows = rows.withColumn("patches", F.map_from_entries("_found")).withColumn("patched_ids", ids(F.col("_found")))
    rows = rows.withColumn("translated", apply_to_segments(F.col("_base"), F.col("patches")))
    left = lambda a: F.filter(a, lambda s: find(F.col("_skipped"), s["id"]).isNull())
    rows = rows.withColumns({"all_source": F.col("source"), "source": left("source"), "_rebuilt": serialize(left("translated"))})
    rows = _with_errors(rows, "_rebuilt", config)
    rows = rows.withColumn("_hidden", index(F.array_union("patched_ids", "skips")))
    visible = F.filter("errors", lambda e: e["id"].isNull() | find(F.col("_hidden"), e["id"]).isNull())
    rows = rows.withColumns({"visible_errors": visible, "patches_applied": F.size("patched_ids"), "translator": translator_id(F.col("model"))})
    when = F.coalesce(iso_seconds(F.col("updated_at")), iso_seconds(F.col("created_at")))
    excerpt = lambda s, i: F.struct(i.alias("pos"), s["id"].alias("id"), s["text"].alias("nass"), F.get("segments", i)["text"].alias("text"), F.col("translator").alias("translator"), when.alias("last_updated_at"))
    clean = F.coalesce(F.size("errors"), F.lit(0)) == 0
    none = F.expr("cast(array() as array<struct<pos:int,id:string,nass:string,text:string,translator:int,last_updated_at:bigint>>)")
    unmapped = clean & (F.size("source") > 0) & F.col("translator").isNull()
    rows = rows.withColumns({
        "error": F.coalesce("_error", F.when(unmapped, F.concat(F.lit("Invalid model: "), F.coalesce("model", F.lit("undefined"))))),
        "is_valid": F.col("_error").isNull() & (F.size("visible_errors") == 0) & ~unmapped,
        "playable": F.when(F.col("_error").isNull() & clean & ~unmapped, F.transform("source", excerpt)).otherwise(none),
    })
    read = lambda c: F.when(F.col("_error").isNull(), F.col(c)).alias(c)
    return rows.select(
        *conversations.columns, *map(read, ("skips", "source", "all_source", "base_texts", "translated", "patches", "patches_applied", "errors", "visible_errors")), "is_valid", "playable",
        patch_metadata(F.col("_edits.patchMetadata")).alias("patch_metadata"),
    )


def _legacy(rows: DataFrame, kind) -> DataFrame:
    """Patches that are unified diffs, added to _found; files without one are null to the Python that reads them."""
    own = F.transform("_base", lambda s: let(F.get(F.col("_values"), find(F.col("_keys"), s["id"])), lambda v: F.struct(
        s["id"].alias("id"), s["text"].alias("text"), F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("diff"))))
    rows = rows.withColumn("_old", F.filter(own, lambda s: s["diff"].isNotNull()))
    some = F.size("_old") > 0
    rows = rows.withColumn("_made", legacy_patches(F.when(some, F.col("_old.text")), F.when(some, F.col("_old.diff"))))
    pairs = F.zip_with("_old", F.coalesce("_made", F.expr(f"cast(array() as array<{OPS}>)")), lambda s, o: F.struct(s["id"].alias("id"), o.alias("ops")))
    made = F.filter(pairs, lambda x: x["ops"].isNotNull())
    return rows.withColumn("_found", F.when(some, F.concat("_found", made)).otherwise(F.col("_found"))).drop("_old", "_made")


def file_rows(analyses: DataFrame) -> DataFrame:
    """(path, model, is_valid, patches_applied, thinking_sec, errors): what operators.files works on."""
    return analyses.select("path", "model", "is_valid", F.coalesce("patches_applied", F.lit(0)).alias("patches_applied"), F.col("reasoning_sec").alias("thinking_sec"), F.coalesce(F.size("visible_errors"), F.lit(0)).alias("n_errors"), "error")


def candidates(analyses: DataFrame) -> DataFrame:
    """The playable excerpts of valid files, for operators.playback; file_order as in sources.conversations.in_tree_order()."""
    from ..sources.conversations import in_tree_order

    rows = in_tree_order(analyses.where("is_valid")).select("file_order", "path", F.explode("playable").alias("e"), "skips", "patch_metadata")
    rows = rows.where(~F.array_contains("skips", F.col("e.id")))
    return rows.select("file_order", "path", "e.pos", "e.id", "e.nass", "e.text", "e.translator", "e.last_updated_at", F.try_element_at("patch_metadata", F.col("e.id")).alias("patch_metadata"))


def invalid_excerpts(analyses: DataFrame) -> DataFrame:
    """A row for each file and excerpt with visible errors; errors without an id share one row of the file, with id null.

    Rows: path, row_order, id, model, arabic, base_translation, translation, error_types, messages, leak_hints,
    caps_hints, ranges. Excerpts of the source come in its order, then other ids, then the file's own row.
    """
    hints = lambda found, kind: F.array_distinct(F.filter(F.transform(F.filter(found, lambda e: e["type"] == kind), lambda e: trim(e["match"])), lambda x: x != ""))
    ranges = lambda found: F.transform(F.filter(found, lambda e: e["segment_start"].isNotNull()), lambda e: F.struct(e["segment_start"].alias("start"), e["segment_end"].alias("end")))
    bad = F.col("visible_errors")
    rows = analyses.where(F.size("visible_errors") > 0).select(
        "path", "model", "visible_errors", "source", "base_texts", "translated", _ids_of(bad).alias("_of"), _ids_of(F.col("source")).alias("_listed"), _ids_of(F.col("base_texts")).alias("_base"),
        _ids_of(F.col("translated")).alias("_new"), F.array_distinct(F.filter(ids(bad), lambda x: x.isNotNull())).alias("_named"),
    )
    listed = F.filter("source", lambda s: find(F.col("_of"), s["id"]).isNotNull())
    extra = F.filter("_named", lambda x: find(F.col("_listed"), x).isNull())
    none = F.lit(None).cast("string")
    shown = F.concat(
        F.transform(listed, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("arabic"))), F.transform(extra, lambda x: F.struct(x.alias("id"), none.alias("arabic"))),
        F.filter(F.array(F.struct(none.alias("id"), none.alias("arabic"))), lambda _: F.exists(bad, lambda e: e["id"].isNull())),
    )

    def joined(r: Column) -> Column:
        """A row with its texts and errors, so that no row carries those of others out of its file."""
        own = F.when(r["id"].isNull(), F.filter(bad, lambda e: e["id"].isNull())).otherwise(F.transform(places(F.col("_of"), r["id"]), lambda k: F.get(bad, k)))
        base, new = (_text_of(F.col(texts), F.col(of), r["id"], True) for texts, of in (("base_texts", "_base"), ("translated", "_new")))
        return F.struct(r["id"].alias("id"), r["arabic"].alias("arabic"), own.alias("own"), base.alias("base"), new.alias("new"))

    exploded = rows.select("path", "model", F.transform(shown, joined).alias("_rows")).select("path", "model", F.posexplode("_rows").alias("row_order", "r"))
    nothing, known, own = F.expr("cast(array() as array<string>)"), F.col("r.id").isNotNull(), F.col("r.own")
    return exploded.select(
        "path", "row_order", F.col("r.id").alias("id"), "model", F.col("r.arabic").alias("arabic"), F.coalesce("r.base", F.when(F.col("r.arabic").isNull(), F.col("r.new"))).alias("base_translation"),
        F.col("r.new").alias("translation"), F.array_distinct(F.transform(own, lambda e: e["type"])).alias("error_types"), F.transform(own, lambda e: e["message"]).alias("messages"),
        F.when(known, hints(own, "arabic_leak")).otherwise(nothing).alias("leak_hints"), F.when(known, hints(own, "all_caps")).otherwise(nothing).alias("caps_hints"),
        F.when(known, ranges(own)).otherwise(F.expr(f"cast(array() as array<{_RANGE}>)")).alias("ranges"),
    )


def fixable(rows: DataFrame, error_type: str | None = None) -> DataFrame:
    """Of invalid_excerpts(), the rows that a correction can mend: with an id, a translation, and a leak or shouting."""
    kinds = [error_type] if error_type else ["arabic_leak", "all_caps"]
    return rows.where(F.col("id").isNotNull() & (F.coalesce(F.length("translation"), F.lit(0)) > 0) & F.arrays_overlap("error_types", F.array(*map(F.lit, kinds))))


def review_rows(analyses: DataFrame) -> DataFrame:
    """A row for each source segment, skipped ones too: path, pos, id, arabic, base_translation, translation, has_patch, is_skipped, is_missing, messages."""
    errors = F.filter("errors", lambda e: e["id"].isNotNull())
    rows = analyses.where("errors is not null").select(
        "path", "base_texts", "translated", "all_source", errors.alias("_errors"), index(F.col("skips")).alias("_skips"), index(F.map_keys("patches")).alias("_patches"), _ids_of(F.col("base_texts")).alias("_base"),
        _ids_of(F.col("translated")).alias("_new"),
    )
    rows = rows.withColumn("_of", _ids_of(F.col("_errors")))

    def joined(s: Column) -> Column:
        base, new = (_text_of(F.col(texts), F.col(of), s["id"], False) for texts, of in (("base_texts", "_base"), ("translated", "_new")))
        skipped = find(F.col("_skips"), s["id"]).isNotNull()
        said = F.when(skipped, F.expr("cast(array() as array<string>)")).otherwise(F.transform(places(F.col("_of"), s["id"]), lambda k: F.get("_errors", k)["message"]))
        return F.struct(s["id"].alias("id"), s["text"].alias("arabic"), base.alias("base"), new.alias("new"), find(F.col("_patches"), s["id"]).isNotNull().alias("has_patch"), skipped.alias("is_skipped"), said.alias("messages"))

    exploded = rows.select("path", F.transform("all_source", joined).alias("_rows")).select("path", F.posexplode("_rows").alias("pos", "r"))
    return exploded.select(
        "path", "pos", "r.id", "r.arabic", F.col("r.base").alias("base_translation"), F.col("r.new").alias("translation"), "r.has_patch", "r.is_skipped",
        (F.coalesce(F.length("r.base"), F.lit(0)) == 0).alias("is_missing"), "r.messages",
    )
