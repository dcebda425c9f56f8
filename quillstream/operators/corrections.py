"""Corrections of leaked Arabic and of all-capital runs: apply, parse, deduplicate, remember."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import trim
from .running import ranks
from .rules import ARABIC

_CORRECTIONS = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("id", "match", "replacement")]))


def _apply(text: Column, corrections: Column, key: Column, refuse: Callable[[Column], Column], said: dict[str, str], hinted: Callable[[Column], Column]) -> Column:
    """struct<text, changed, issues, highlights> after all corrections (struct<match, replacement>) in turn; repeated ones count once."""
    kind = "struct<text:string,changed:boolean,issues:array<string>,highlights:array<struct<start:int,end:int,title:string>>>"
    none = F.struct(text.alias("text"), F.lit(False).alias("changed"), F.expr("cast(array() as array<string>)").alias("issues"), F.expr("cast(array() as array<struct<start:int,end:int,title:string>>)").alias("highlights"))

    def add(acc: Column, c: Column) -> Column:
        gaps = F.split(acc["text"], F.concat(F.lit("\\Q"), F.replace(c["match"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
        found = F.when(F.length(c["match"]) > 0, F.contains(acc["text"], c["match"])).otherwise(F.lit(False))
        tell = lambda what: F.concat(F.lit(said[what][0]), c["match"], F.lit(said[what][1]), key, F.lit("."))
        issue = F.when(refuse(c["match"]), tell("refused")).when(~hinted(c["match"]), tell("unmatched")).when(~found, tell("absent"))
        size = F.length(c["replacement"])
        none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,title:string>>)").alias("out"))

        def mark(m: Column, gap: Column) -> Column:
            begin = m["at"] + F.length(gap)
            return F.struct((begin + size).alias("at"), F.array_append(m["out"], F.struct(begin.alias("start"), (begin + size).alias("end"), c["match"].alias("title"))).alias("out"))

        marks = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), none, mark, lambda m: m["out"])
        return F.struct(
            F.when(issue.isNull(), F.replace(acc["text"], c["match"], c["replacement"])).otherwise(acc["text"]).alias("text"),
            (acc["changed"] | issue.isNull()).alias("changed"),
            F.when(issue.isNull(), acc["issues"]).otherwise(F.array_append(acc["issues"], issue)).alias("issues"),
            F.when(issue.isNull(), F.concat(acc["highlights"], marks)).otherwise(acc["highlights"]).alias("highlights"),
        ).cast(kind)

    pairs = F.array_distinct(F.transform(corrections, lambda c: F.struct(c["match"].alias("match"), c["replacement"].alias("replacement"))))
    return F.aggregate(pairs, none.cast(kind), add)


def fix_arabic_leaks(text: Column, corrections: Column, hints: Column, key: Column) -> Column:
    """Replace leaked Arabic. A match must hold Arabic and, if there are hints, contain one or be part of one."""
    refuse = lambda m: ~F.replace(m, F.lit("ﷺ"), F.lit("")).rlike(ARABIC)
    near = lambda m: (F.size(hints) == 0) | F.exists(hints, lambda h: (trim(h) != "") & (F.contains(m, trim(h)) | F.contains(trim(h), m)))
    said = {
        "refused": ('Skipping non-Arabic correction "', '" in excerpt '), "unmatched": ('Skipping unmatched Arabic correction "', '" in excerpt '),
        "absent": ('Could not find "', '" in excerpt '),
    }
    return _apply(text, corrections, key, refuse, said, near)


def fix_all_caps(text: Column, corrections: Column, hints: Column, key: Column) -> Column:
    """Replace shouting. A match must have capitals and no small letters and, if there are hints, equal one."""
    refuse = lambda m: ~m.rlike(r"\p{Lu}") | m.rlike(r"\p{Ll}")
    near = lambda m: (F.size(hints) == 0) | F.exists(hints, lambda h: (trim(h) != "") & (trim(m) == trim(h)))
    said = {
        "refused": ('Skipping non-ALL-CAPS correction "', '" in excerpt '), "unmatched": ('Skipping unmatched ALL-CAPS correction "', '" in excerpt '),
        "absent": ('Could not find "', '" in excerpt '),
    }
    return _apply(text, corrections, key, refuse, said, near)


def recover_json(text: str) -> str | None:
    """The longest prefix from the first '{' that is JSON; the decoder's own end is tried first."""
    start = text.find("{")
    if start < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text, start)
        return text[start:end] + text[end:][: len(text[end:]) - len(text[end:].lstrip(" \t\n\r"))]
    except ValueError:
        return None


@pandas_udf(_CORRECTIONS)
def parse_corrections(reply: pd.Series) -> pd.Series:
    """The corrections of a model's reply, {corrections: [...]} or {results: {id: [...]}}; null if it is neither."""

    def one(text: str | None) -> list[dict] | None:
        body = recover_json(text) if text else None
        data = json.loads(body) if body else None
        if not isinstance(data, dict):
            return None
        text_pair = lambda c: isinstance(c, dict) and all(isinstance(c.get(k), str) for k in ("match", "replacement"))
        rows = data.get("corrections")
        if isinstance(rows, list) and all(text_pair(c) and isinstance(c.get("id"), str) for c in rows):
            found = [c for c in rows if c["id"].strip()]
        elif isinstance(data.get("results"), dict) and all(isinstance(v, list) and all(map(text_pair, v)) for v in data["results"].values()):
            found = [c | {"id": k} for k, v in data["results"].items() for c in v]
        else:
            return None
        keys = dict.fromkeys((c["id"], c["match"], c["replacement"]) for c in found if c["match"] and c["replacement"])
        return [{"id": i, "match": m, "replacement": r} for i, m, r in keys]

    return reply.map(one)


def attach(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows(path, id, ...) with their corrections, in order of pos; corrections(path, pos, id, match, replacement) whose row is missing are left out."""
    grouped = corrections.groupBy("path", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "match", "replacement"))).alias("corrections"))
    return rows.join(grouped, ["path", "id"], "left")


def unmatched(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    return corrections.join(rows.select("path", "id"), ["path", "id"], "left_anti")


def sightings(observations: DataFrame) -> DataFrame:
    """(match, position, path, id, replacement, is_new) of observations(pos, match, path, id, replacement): every sighting of a match in order, from 1, and whether its
    replacement is the first of its kind. A match may have any number."""
    rows = ranks(observations.withColumn("match", trim(F.col("match"))).where("match <> ''"), ["match"], ["pos", "path", "id", "replacement"], "position")
    first = rows.groupBy("match", "replacement").agg(F.min("position").alias("position")).withColumn("is_new", F.lit(True))
    rows = rows.alias("r").hint("merge").join(first.alias("f"), (F.col("r.match") == F.col("f.match")) & F.col("r.replacement").eqNullSafe(F.col("f.replacement")) & (F.col("r.position") == F.col("f.position")), "left")
    return rows.select("r.match", "r.position", "r.path", "r.id", "r.replacement", F.coalesce("f.is_new", F.lit(False)).alias("is_new"))


def dictionary(observations: DataFrame) -> DataFrame:
    """(match, observations, responses) of observations(pos, match, path, id, replacement): all sightings, and each replacement once, in order, as arrays: for matches of a size to be read."""
    rows = observations.withColumn("match", trim(F.col("match"))).where("match <> ''")
    grouped = rows.groupBy("match").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "id", "replacement"))).alias("seen"))
    return grouped.select(
        "match", F.transform("seen", lambda s: F.concat_ws("#", s["path"], s["id"])).alias("observations"),
        F.array_distinct(F.transform("seen", lambda s: s["replacement"])).alias("responses"),
    )


def first_of_each(corrections: DataFrame) -> DataFrame:
    """Each (id, match, replacement) once, the first by pos."""
    rank = F.row_number().over(Window.partitionBy("id", "match", "replacement").orderBy("pos"))
    return corrections.withColumn("_n", rank).where("_n = 1").drop("_n")


def request(rows: DataFrame, instructions: str) -> DataFrame:
    """(path, request) of rows(path, id, translation, hints): the instructions, and the excerpts of a file as JSON, by id."""
    item = F.struct("id", F.col("translation").alias("text"), "hints")
    return rows.groupBy("path").agg(F.concat(F.lit(instructions.strip() + "\n"), F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("excerpts")))).alias("request"))


def reply_schema() -> dict:
    """The JSON schema that a reply must follow."""
    text = {"type": "string"}
    entry = {"type": "object", "properties": {"match": text, "replacement": text}, "required": ["match", "replacement"]}
    return {"type": "object", "properties": {"results": {"type": "object", "additionalProperties": {"type": "array", "items": entry}}}, "required": ["results"]}


def resolve(replies: DataFrame, requested: DataFrame) -> DataFrame:
    """replies(pos, id, match, replacement) with the path of their excerpt in requested(path, id).

    An id that was not asked for, or that stands in two files, raises an error when the result is read.
    """
    homes = requested.groupBy("id").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n"))
    joined = replies.join(homes, "id", "left")
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("id")))
    path = F.when(F.col("n").isNull(), fail("unknown excerpt ")).when(F.col("n") > 1, fail("excerpt of two files ")).otherwise(F.col("path"))
    return joined.select(path.alias("path"), *replies.columns)
