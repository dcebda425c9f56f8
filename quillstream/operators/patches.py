"""Character-range patches: check, apply, highlight and create.

A patch is array<struct<start, end, text>>: replace [start, end) by text. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.arrays import find, index, let, running_sums
from ..functions.diff import code_points, differences, repeats_run, shares_run

OPS = "array<struct<start:int,end:int,text:string>>"
_OPS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
#: A patch of at least so many edits that changes at least this share of a text becomes one replacement.
COLLAPSE_OPS, COLLAPSE_SHARE = 4, 0.5


def ordered(ops: Column) -> Column:
    """Edits by start and end; edits of one place keep their order."""
    numbered = F.transform(ops, lambda o, i: F.struct(o["start"].alias("start"), o["end"].alias("end"), i.alias("i"), o["text"].alias("text")))
    return F.transform(F.array_sort(numbered), lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["text"].alias("text")))


def checked(ops: Column) -> Column:
    """The patch in order; null if it is empty or malformed, or edits overlap."""
    def right(a: Column) -> Column:
        fits = lambda o, i: (o["start"] >= F.when(i > 0, F.get(a, i - 1)["end"]).otherwise(0)) & (o["start"] <= o["end"]) & o["text"].isNotNull()
        return (F.size(a) > 0) & ~F.exists(F.transform(a, lambda o, i: F.coalesce(fits(o, i), F.lit(False))), lambda ok: ~ok)

    return let(ordered(ops), lambda a: F.when(right(a), a.cast(OPS)))


def apply_patch(text: Column, ops: Column) -> Column:
    """The patched text; null if the patch doesn't fit it."""
    def patched(a: Column) -> Column:
        since = lambda i: F.when(i > 0, F.get(a, i - 1)["end"]).otherwise(0)
        pieces = F.transform(a, lambda o, i: F.concat(F.substring(text, since(i) + 1, o["start"] - since(i)), o["text"]))
        end = F.get(a, F.size(a) - 1)["end"]
        return F.when(end <= F.length(text), F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text))))

    return let(checked(ops), patched)


def apply_to_segments(parsed: Column, patches: Column) -> Column:
    """Segments (structs with id and text) with their patches from map<id, ops> applied where they fit."""
    def each(own: Column) -> Column:
        patched = lambda s: F.coalesce(apply_patch(s["text"], F.get(own["ops"], find(own["ids"], s["id"]))), s["text"])
        return F.transform(parsed, lambda s: F.struct(s["id"].alias("id"), patched(s).alias("text")))

    own = F.coalesce(patches, F.expr(f"cast(map() as map<string,{OPS}>)"))
    return let(F.struct(index(F.map_keys(own)).alias("ids"), F.map_values(own).alias("ops")), each)


def highlight_ranges(ops: Column) -> Column:
    """array<struct<start, end>> of the inserted texts in the patched text."""
    def ranges(a: Column) -> Column:
        grown = F.transform(a, lambda o: F.length(o["text"]) - (o["end"] - o["start"]))

        def placed(sums: Column) -> Column:
            at = lambda o, i: o["start"] + F.get(sums, i) - (F.length(o["text"]) - (o["end"] - o["start"]))
            every = F.transform(a, lambda o, i: F.struct(at(o, i).alias("start"), (at(o, i) + F.length(o["text"])).alias("end")))
            return F.filter(every, lambda r: r["start"] < r["end"])

        return let(running_sums(grown), placed)

    return F.coalesce(let(checked(ops), ranges), F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def merge_highlights(text: Column, highlights: Column) -> Column:
    """Highlights array<struct<start, end, title>>, sorted; untitled ones that touch, or have blanks alone between them, become one."""
    kind = "array<struct<start:int,end:int,title:string>>"
    solid = F.array_sort(F.filter(highlights, lambda h: h["start"] < h["end"])).cast(kind)
    bare = lambda h: F.coalesce(F.length(h["title"]), F.lit(0)) == 0

    def add(out: Column, h: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        gap = F.substring(text, last["end"] + 1, h["start"] - last["end"])
        joins = bare(last) & bare(h) & ((h["start"] <= last["end"]) | gap.rlike(r"\A[ \t]+\z"))
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"), F.lit(None).cast("string").alias("title"))
        return F.when((F.size(out) > 0) & joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(one))).otherwise(F.concat(out, F.array(h))).cast(kind)

    return F.when(F.size(highlights) <= 1, highlights.cast(kind)).otherwise(F.aggregate(solid, F.expr(f"cast(array() as {kind})"), add))


def display_highlights(text: Column, ops: Column, titled: Column, ranges: Column) -> Column:
    """What to show of a patched text: its own highlights, else its ranges, else where the patch changed it."""
    untitled = lambda a: F.transform(a, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(None).cast("string").alias("title")))
    return F.when(F.size(titled) > 0, titled).when(F.size(ranges) > 0, untitled(ranges)).otherwise(merge_highlights(text, untitled(highlight_ranges(ops))))


#: Characters from which on it pays to prove that a search isn't needed.
LONG = 20_000


def _surely_many(a: str, b: str, tail: str) -> bool:
    """Whether every shortest script from a + tail to b + tail has COLLAPSE_OPS edits or more; a and b begin and end unlike.

    With fewer edits, at most COLLAPSE_OPS - 2 runs stay beside that at the end, which is no longer than the tail. They must make up for
    the rest of the longest common subsequence, in which one character alone has as many places as the text with fewer of it. A run that isn't in
    the tail of both lies in b, in a, or pairs the tail with another place of it; where none of these parts can be long enough, there are more edits.
    """
    x, y, t = (code_points(s) for s in (a, b, tail))
    here, counts = np.unique(x, return_counts=True)
    there, others = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(here, there, return_indices=True)
    most = int(np.minimum(counts[i], others[j]).max(initial=0))
    size = most // ((COLLAPSE_OPS - 2) * (3 if tail else 1))
    if size < 1:
        return False
    if not tail:
        return not shares_run(x, y, size)
    return not (shares_run(np.append(x, t), y, size) or shares_run(x, np.append(y, t), size) or repeats_run(t, size))


def edits(before: str, after: str) -> list[dict]:
    """The edits of a shortest script from one text to another, collapsed to one where they amount to a replacement.

    Long texts without much in common would take a long search only to be collapsed: there it is proved first that the script has that many edits.
    """
    if before == after:
        return []
    x, y = code_points(before), code_points(after)
    most = min(len(x), len(y))
    unlike = np.flatnonzero(x[:most] != y[:most])
    head = int(unlike[0]) if len(unlike) else most
    unlike = np.flatnonzero(x[len(x) - most + head :][::-1] != y[len(y) - most + head :][::-1])
    tail = int(unlike[0]) if len(unlike) else most - head
    a, b = before[head : len(before) - tail], after[head : len(after) - tail]
    replaces = max(len(a) / max(len(before), 1), len(b) / max(len(after), 1)) >= COLLAPSE_SHARE
    whole = [{"start": head, "end": len(before) - tail, "text": b}]
    if replaces and a and b and len(a) + len(b) > LONG and _surely_many(a, b, before[len(before) - tail :]):
        return whole
    ops = [{"start": i, "end": j, "text": after[k:m]} for i, j, k, m in differences(before, after)]
    return whole if replaces and len(ops) >= COLLAPSE_OPS else ops


@pandas_udf(_OPS)
def create_patch(before: pd.Series, after: pd.Series) -> pd.Series:
    """The patch from before to after; null if they are equal or one is null."""
    return pd.Series([edits(a, b) or None if a is not None and b is not None else None for a, b in zip(before, after)])


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def _hunks(diff: list[str]) -> list[tuple[int, list[str]]] | None:
    """The hunks of a unified diff as (first line that goes or is passed, from 0; marked lines); None if a hunk hasn't the lines it tells of."""
    found, k = [], 0
    while k < len(diff):
        head = _HUNK.match(diff[k])
        k += 1
        if not head:
            continue
        old, new = (1 if n is None else int(n) for n in head.group(2, 3))
        rows, gone, made = [], 0, 0
        while k < len(diff) and (gone < old or made < new or diff[k][:1] == "\\"):
            row = diff[k] or (" " if k < len(diff) - 1 else "")
            if row[:1] not in (" ", "-", "+", "\\"):
                return None
            gone, made = gone + (row[0] in " -"), made + (row[0] in " +")
            rows.append(row)
            k += 1
        # a side told as one line may have none
        if (gone, made) != (old, new) and (gone or 0 if old == 1 and not gone else old, made or 0 if new == 1 and not made else new) != (gone, made):
            return None
        found.append((int(head[1]) - (gone > 0), rows))
    return found


def _place(lines: list[str], where: dict[str, list[int]], old: list[str], start: int, low: int) -> int | None:
    """Where from low on a hunk's old lines stand, nearest to start; of two as near the later."""
    high = len(lines) - len(old)
    if not old:
        return min(max(start, low), high) if low <= high else None
    near = sorted((p for p in where.get(old[0], ()) if low <= p <= high), key=lambda p: (abs(p - start), p < start))
    return next((p for p in near if lines[p : p + len(old)] == old), None)


def apply_unified(text: str, diff: str) -> str | None:
    """text after a unified diff; None if the diff is malformed, has no hunk or a hunk fits nowhere.

    A hunk that doesn't fit at the line it tells, moved as the hunk before it was, goes to the nearest place where it fits, behind that hunk. A diff with
    \r\n ends fits a text with \n ends. Where the diff says so, the last line's end is added or taken away.
    """
    rows = diff.split("\n")
    if "\r" not in text and any(r.endswith("\r") for r in rows) and all(r.endswith("\r") or r == "" for r in rows):
        rows = [r.removesuffix("\r") for r in rows]
    hunks = _hunks(rows)
    if not hunks:
        return None
    lines, ends = text.split("\n"), {a[:1] for a, b in zip(hunks[-1][1], hunks[-1][1][1:]) if b[:1] == "\\"}
    if {"+", "-"} <= ends:
        if lines[-1] == "":
            return None
    elif "+" in ends:
        if lines.pop() != "":
            return None
    elif "-" in ends:
        if lines[-1] == "":
            return None
        lines.append("")
    where: dict[str, list[int]] = {}
    for k, line in enumerate(lines):
        where.setdefault(line, []).append(k)
    out, at, moved = [], 0, 0
    for start, marked in hunks:
        old = [r[1:] for r in marked if r[0] in " -"]
        place = _place(lines, where, old, start + moved, at)
        if place is None:
            return None
        out += lines[at:place] + [r[1:] for r in marked if r[0] in " +"]
        at, moved = place + len(old), place - start
    return "\n".join(out + lines[at:])


@pandas_udf(T.ArrayType(_OPS))
def legacy_patches(texts: pd.Series, diffs: pd.Series) -> pd.Series:
    """The patches that old unified diffs stand for, one for each text; null for a diff that doesn't fit."""

    def one(text: str, diff: str) -> list[dict] | None:
        made = apply_unified(text, diff)
        return None if made is None else edits(text, made) or None

    return pd.Series([[one(t, d) for t, d in zip(ts, ds)] if ts is not None else None for ts, ds in zip(texts, diffs)])


# not to be copied into the lambdas of later steps, where Python can't run
legacy_patches = legacy_patches.asNondeterministic()


_RANGE = "struct<start:int,end:int>"
METADATA = f"struct<appliedAt:string,highlights:array<struct<range:{_RANGE},title:string>>,highlightRanges:array<{_RANGE}>,source:struct<kind:string,model:string,modelVersion:string,provider:string,task:string>>"
# fixed values: what a patch's metadata may name
PROVIDERS = ("cloudflare", "google", "huggingface", "nvidia", "openrouter")
TASKS = ("all_caps_correction", "arabic_leak_correction")


def _kind(value: Column) -> Column:
    """The JSON type of a variant: its first word; '' where the member isn't there."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))


def metadata_is_valid(value: Column) -> Column:
    """Whether a variant is a patch's metadata, field by field: all that must be there is, what may be there has its type, ranges are whole numbers
    in order, and provider and task are known ones. Members that aren't asked for do no harm; a null value is none."""
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    text = lambda v, path: F.try_variant_get(v, path, "string")
    is_text = lambda v, path: _kind(at(v, path)) == "STRING"
    maybe_text = lambda v, path: _kind(at(v, path)).isin("", "STRING")
    whole = lambda v, path: _kind(at(v, path)).isin("BIGINT", "DECIMAL", "DOUBLE") & F.coalesce(F.try_variant_get(v, path, "double") == F.floor(F.try_variant_get(v, path, "double")), F.lit(False))
    place = lambda v, path: F.try_variant_get(v, path, "double")
    in_order = lambda v, root: whole(v, f"{root}.start") & whole(v, f"{root}.end") & F.coalesce((place(v, f"{root}.start") >= 0) & (place(v, f"{root}.end") >= place(v, f"{root}.start")), F.lit(False))

    def each(path: str, right: Callable[[Column], Column]) -> Column:
        found = F.try_variant_get(value, path, "array<variant>")
        return (_kind(at(value, path)) == "") | ((_kind(at(value, path)) == "ARRAY") & ~F.exists(F.coalesce(found, F.expr("cast(array() as array<variant>)")), lambda v: ~right(v)))

    return F.coalesce(
        (_kind(value) == "OBJECT") & (_kind(at(value, "$.source")) == "OBJECT") & is_text(value, "$.appliedAt") & (text(value, "$.source.kind") == "llm") & is_text(value, "$.source.kind") & is_text(value, "$.source.model")
        & is_text(value, "$.source.provider") & text(value, "$.source.provider").isin(*PROVIDERS) & is_text(value, "$.source.task") & text(value, "$.source.task").isin(*TASKS) & maybe_text(value, "$.source.modelVersion")
        & each("$.highlights", lambda v: (_kind(v) == "OBJECT") & in_order(v, "$.range") & maybe_text(v, "$.title")) & each("$.highlightRanges", lambda v: in_order(v, "$")),
        F.lit(False),
    )


def metadata(values: Column) -> Column:
    """map<id, METADATA> of map<id, variant>: the entries that are valid."""
    found = F.map_filter(values, lambda k, v: metadata_is_valid(v))
    return F.transform_values(found, lambda k, v: F.from_json(F.to_json(v), METADATA))


def upsert(patches: Column, key: Column, ops: Column, base: Column, edited: Column) -> Column:
    """map<id, ops> with one entry replaced; an edit that gives the base text again drops the entry, and an empty map is null."""
    rest = F.map_filter(F.coalesce(patches, F.expr(f"cast(map() as map<string,{OPS}>)")), lambda k, v: k != key)
    out = F.when(base == edited, rest).otherwise(F.map_concat(rest, F.create_map(key, ops)))
    return F.when(F.size(out) > 0, out)


def prune(metadata: Column, patches: Column) -> Column:
    """Patch metadata (a map by id) without the entries whose patch is gone; null if nothing is left."""
    out = F.map_filter(metadata, lambda k, v: F.coalesce(F.map_contains_key(patches, k), F.lit(False)))
    return F.when(F.size(out) > 0, out)


def clean_skips(skips: Column) -> Column:
    from ..functions.text import is_blank

    return F.filter(F.coalesce(skips, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & ~is_blank(x))


def set_skip(skips: Column, known: Column, key: Column, skipped: Column) -> Column:
    """The sorted skip list with key put in or taken out; unknown ids go, and an empty list is null."""
    own = F.filter(clean_skips(skips), lambda x: F.array_contains(known, x) & (x != key))
    out = F.array_sort(F.array_distinct(F.when(skipped & F.array_contains(known, key), F.array_append(own, key)).otherwise(own)))
    return F.when(F.size(out) > 0, out)
