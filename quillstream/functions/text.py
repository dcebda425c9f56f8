"""Text functions, Column to Column: trimming, normalizing, segmenting, and spans with offsets.

Offsets and lengths count code points, except in utf16_length().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import count, find, index, let, running_sums

# fixed values: the white space of the data's own rules (Unicode's, without U+0085, with U+FEFF), and the shape of a segment marker
WS = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
DASH = "[-–—]"
MARKER_LETTERS = "[BFTCNP]"
MARKER_ID = MARKER_LETTERS + r"\d+[a-z]?"
MARKER = f"{MARKER_ID}[{WS}]?{DASH}"
SPEAKER_LABEL = r"(?:^|\n|[" + WS + r"])([A-Z][\p{L}'ʿʾāīūḥṣḍṭẓ-]*(?:[" + WS + r"]+[A-Z][\p{L}'ʿʾāīūḥṣḍṭẓ-]*){0,2})[" + WS + "]*:"
_BREAK = r"[\n\x{2028}\x{2029}]"
_SPECIAL = r".*+?^${}()|[]\/"


def trim(c: Column) -> Column:
    """Without white space (WS) at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(trim(c)), F.lit(0)) == 0


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def normalize(c: Column) -> Column:
    """Line ends to \\n, every glued or spaced marker on a line of its own, \\[ to [."""
    lines = F.regexp_replace(c, "\r\n?", "\n")
    # the look-ahead settles most places with two cheap steps
    glued = F.regexp_replace(lines, f"(?s)(?=.{MARKER_LETTERS}\\d)([^{WS}])({MARKER})", "$1\n$2")
    spaced = F.regexp_replace(glued, f" ({MARKER})", "\n$1")
    return F.replace(spaced, F.lit("\\["), F.lit("["))


def marker_ids(normalized: Column) -> Column:
    """The ids of all markers at line starts, in order."""
    return F.regexp_extract_all(normalized, F.lit(f"(?:\\A|{_BREAK})({MARKER_ID})[{WS}]?{DASH}"), F.lit(1))


def segments(normalized: Column) -> Column:
    """array<struct<pos, id, text, head, start, end>> of a normalized text.

    head: where the marker begins; start, end: the trimmed text. What stands before the first marker is
    dropped; repeated ids are kept, in order.
    """
    chunks = F.split(normalized, f"{_BREAK}(?={MARKER})", -1)
    header = f"\\A({MARKER_ID})[{WS}]?{DASH}[{WS}]*"

    def parts(chunk: Column) -> Column:
        head = F.length(F.regexp_extract(chunk, header, 0))
        return let(head, lambda h: F.struct(
            F.regexp_extract(chunk, header, 1).alias("id"), F.rtrim(F.substr(chunk, h + 1), F.lit(WS_CHARS)).alias("text"), h.alias("head"), (F.length(chunk) + 1).alias("size")))

    def placed(a: Column, ends: Column) -> Column:
        def row(c: Column, i: Column) -> Column:
            at = F.get(ends, i) - c["size"]
            # an empty text is where the next marker begins, or the whole text ends
            start = at + c["head"] + F.when((c["text"] == "") & (i < F.size(a) - 1), 1).otherwise(0)
            return F.struct(c["id"].alias("id"), c["text"].alias("text"), at.alias("head"), start.alias("start"), (start + F.length(c["text"])).alias("end"))

        named = F.filter(F.transform(a, row), lambda r: r["id"] != "")
        return F.transform(named, lambda r, i: F.struct(i.alias("pos"), *(r[k].alias(k) for k in ("id", "text", "head", "start", "end"))))

    return let(F.transform(chunks, parts), lambda a: let(running_sums(F.transform(a, lambda c: c["size"])), lambda ends: placed(a, ends)))


def segment_map(parsed: Column) -> Column:
    """map<id, text> of segments(); the last of a repeated id wins."""
    def last(parsed: Column, ids: Column) -> Column:
        return F.filter(parsed, lambda s, i: find(ids, s["id"], last=True) == i)

    kept = let(parsed, lambda p: let(index(F.transform(p, lambda s: s["id"])), lambda ids: last(p, ids)))
    return F.map_from_entries(F.transform(kept, lambda s: F.struct(s["id"], s["text"])))


def spans(c: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of all matches of a pattern that never matches the empty string.

    What split() leaves between the matches, and the matches, add up to the text: their running length is
    each match's place.
    """
    def placed(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(c, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(m.alias("match"), (F.length(g) + F.length(m)).alias("size")))
        return let(running_sums(F.transform(pairs, lambda p: p["size"])), lambda ends: F.transform(found, lambda m, i: F.struct(
            m.alias("text"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"))))

    empty = F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)")
    return let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(placed(found)))


def occurrences(c: Column, literal: Column) -> Column:
    """How often a literal stands in a text, without overlaps; 0 for an empty literal."""
    n = F.length(literal)
    return F.when(n > 0, ((F.length(c) - F.length(F.replace(c, literal, F.lit("")))) / n).cast("int")).otherwise(0)


def serialize(parsed: Column) -> Column:
    """`id - text` blocks, with a blank line between them."""
    return F.array_join(F.transform(parsed, lambda s: F.concat(s["id"], F.lit(" - "), s["text"])), "\n\n")


def prompt_with_segments(prompt: Column, parsed: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n"), serialize(parsed))


def escape_regex(literal: str) -> str:
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in literal)


def label_pattern(labels: list[str]) -> str:
    """An alternation of speaker labels with their colon."""
    return "(?:" + "|".join(f"{escape_regex(x)}[{WS}]*:" for x in labels) + ")"


def punctuation_pattern(tokens: list[str]) -> str:
    return "|".join(map(escape_regex, tokens))


def line_start_label_pattern(labels: list[str]) -> str:
    """A label at the start of a line, behind a marker or not."""
    return f"^(?:{MARKER}[{WS}]*)?({label_pattern(labels)})"


def speaker_labels(c: Column) -> Column:
    """Labels that stand twice or more before a colon, in order of first appearance."""
    found = F.regexp_extract_all(c, F.lit(SPEAKER_LABEL), F.lit(1))
    return let(found, lambda f: let(index(f), lambda names: F.filter(F.array_distinct(f), lambda x: count(names, x) >= 2)))
