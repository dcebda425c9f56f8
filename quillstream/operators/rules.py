"""Validation of translated responses: a list of rules, each a Column of typed error spans.

A rule gets the Context of a row and gives an array of errors. Register more with rule(), or pass a list of
one's own to validate().
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions.arrays import count_before, find, index, let
from ..functions.text import DASH, MARKER_ID, MARKER_LETTERS, WS, marker_ids, normalize, segments, spans, trim, utf16_length

ERROR = "struct<type:string,message:string,match:string,start:int,end:int,id:string,segment_start:int,segment_end:int>"
NO_ERRORS = f"cast(array() as array<{ERROR}>)"

# fixed values: the names of the error types; what is said of them is in this library's own words
ERROR_TYPES = {
    "all_caps": "A run of words in capitals only.",
    "arabic_leak": "Arabic script in the output (ﷺ is allowed).",
    "collapsed_speakers": "A speaker label stands within a line.",
    "duplicate_id": "A segment id stands more than once in the response.",
    "empty_parentheses": "Too many empty parentheses: terms are missing.",
    "invalid_marker_format": "A marker line is malformed.",
    "invented_id": "An id that the source doesn't have.",
    "length_mismatch": "The translation is much too short for its source.",
    "missing_id_gap": "Ids of the source are missing or out of order.",
    "multiword_translit_without_gloss": "A transliterated phrase without a gloss in parentheses.",
    "newline_after_id": "A line break right after the marker.",
    "no_valid_markers": "No marker at all.",
    "truncated_segment": "A segment that is empty or only an ellipsis.",
}
MAX_EMPTY_PARENTHESES, MIN_SOURCE_CHARS, MIN_RATIO = 3, 50, 0.25
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDF9}\x{FDFB}-\x{FDFF}\x{FE70}-\x{FEFF}]"
_TRANSLIT = "[a-zʿʾāīūḥṣḍṭẓ-]"
_WORD = "A-Za-z0-9_"


@dataclass(frozen=True)
class Config:
    all_caps_words: int = 5


@dataclass(frozen=True)
class Context:
    """The columns of a row that rules read."""

    normalized: Column
    segments: Column  # of the response: array<struct<pos, id, text, head, start, end>>
    source: Column  # array<struct<id, text>>
    config: Config = field(default_factory=Config)
    # the ids of both, as functions.arrays.index() has them; columns, as rules read them inside lambdas
    segment_ids: Column | None = None
    source_ids: Column | None = None

    def home(self, start: Column, end: Column, name: Column | None = None) -> Column:
        """The segment that is named, the first of its id, or else holds [start, end)."""
        if name is not None:
            found = index(F.transform(self.segments, lambda s: s["id"])) if self.segment_ids is None else self.segment_ids
            return F.get(self.segments, find(found, name))
        last = F.get(self.segments, count_before(self.segments, lambda s: s["start"] <= start) - 1)
        return F.when(last["end"] >= end, last)

    def error(self, kind: str, message: Column, match: Column, start: Column, end: Column, name: Column | None = None) -> Column:
        """An error at [start, end) of the normalized response, within the segment that is named or else holds it."""
        def row(x: Column) -> Column:
            place = lambda at: F.when(x["home"].isNotNull(), F.greatest(x["home"]["start"], at) - x["home"]["start"])
            return F.struct(
                F.lit(kind).alias("type"), x["message"].alias("message"), x["match"].alias("match"), x["start"].alias("start"), x["end"].alias("end"),
                (x["home"]["id"] if name is None else name).alias("id"), place(x["start"]).alias("segment_start"), place(x["end"]).alias("segment_end"),
            ).cast(ERROR)

        parts = F.struct(message.alias("message"), match.alias("match"), start.alias("start"), end.alias("end"), self.home(start, end, name).alias("home"))
        return let(parts, row)

    def source_text(self, name: Column) -> Column:
        """The source text of an id, the last if there are more; null if there is none."""
        found = index(F.transform(self.source, lambda s: s["id"])) if self.source_ids is None else self.source_ids
        return F.get(self.source, find(found, name, last=True))["text"]

    def matches(self, kind: str, pattern: str, message: Callable[[Column], Column]) -> Column:
        """An error for each match in the whole response."""
        return F.transform(spans(self.normalized, pattern), lambda m: self.error(kind, message(m["text"]), m["text"], m["start"], m["end"]))


Rule = Callable[[Context], Column]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Register a rule; it runs after those that are there."""

    def add(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return add


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@rule("invalid_marker_format")
def marker_format(c: Context) -> Column:
    kind, digits = "invalid_marker_format", r"\d+"
    shape = f"(?m)^{MARKER_LETTERS}(?={digits})(?=.*{DASH})(?!{digits}[a-z]*[{WS}]?{DASH})[^{WS}\\-–—]+[{WS}]?{DASH}"
    return F.concat(
        c.matches(kind, shape, lambda m: _say('Invalid reference format "', trim(m), '" - expected format is letter + numbers + optional suffix (a-j) + dash')),
        c.matches(kind, f" {MARKER_LETTERS}{digits}[a-z]+[{WS}]?{DASH}", lambda m: _say('Suspicious reference found: "', m, '"')),
        c.matches(kind, f"(?m)^{MARKER_LETTERS}{digits}[a-z](?! {DASH})", lambda m: _say('Suspicious reference found: "', m, '"')),
        c.matches(kind, f"(?m)^{MARKER_ID}[{WS}]?{DASH}[{WS}]*$", lambda m: _say('Reference "', trim(m), '" has dash but no content after it')),
        c.matches(kind, f"(?m)^{MARKER_LETTERS}{digits}\\${digits}", lambda m: _say('Invalid reference format "', m, '" - contains $ character')),
    )


@rule("newline_after_id")
def newline_after_id(c: Context) -> Column:
    return c.matches(
        "newline_after_id", f"(?m)^{MARKER_ID}[{WS}]?{DASH}[{WS}]*\n", lambda m: _say('Invalid format: newline after ID "', trim(m), '" - use "ID - Text" format')
    )


@rule("truncated_segment")
def truncated(c: Context) -> Column:
    only_dots = lambda s: F.coalesce(c.source_text(s["id"]), F.lit("")).rlike(rf"\A[{WS}]*(?:…|\.{{3}})[{WS}]*\z")
    bad = F.filter(c.segments, lambda s: (s["text"] == "") | (s["text"] == "[INCOMPLETE]") | (s["text"].isin("…", "...") & ~only_dots(s)))
    return F.transform(
        bad, lambda s: _plain(c, "truncated_segment", _say('Truncated segment detected: "', s["id"], '" - segments must be fully translated'), s)
    )


def _plain(c: Context, kind: str, message: Column, s: Column) -> Column:
    """An error of a whole segment; it names no range within the segment."""
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(kind).alias("type"), message.alias("message"), s["text"].alias("match"), s["start"].alias("start"), s["end"].alias("end"), s["id"].alias("id"),
        none.alias("segment_start"), none.alias("segment_end"),
    ).cast(ERROR)


def _each_segment(c: Context, find: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """Errors for what find() gives of every segment's text, with offsets in that text."""
    return F.flatten(F.transform(c.segments, lambda s: F.transform(find(s), lambda m: make(s, m))))


@rule("arabic_leak")
def arabic_leak(c: Context) -> Column:
    shown = lambda m: trim(F.replace(m["text"], F.lit("ﷺ"), F.lit("")))
    find = lambda s: F.filter(spans(s["text"], f"{ARABIC}+(?:[{WS}]+{ARABIC}+)*"), lambda m: shown(m) != "")
    say = lambda text: _say('Arabic script detected: "', text, '"')
    return _each_segment(c, find, lambda s, m: c.error("arabic_leak", say(shown(m)), shown(m), s["start"] + m["start"], s["start"] + m["end"], s["id"]))


@rule("empty_parentheses")
def empty_parentheses(c: Context) -> Column:
    n = F.regexp_count(c.normalized, F.lit(r"\(\)"))
    said = _say(
        "Found ", n, ' empty parentheses "()" - this usually indicates failed transliterations. Please check if the LLM omitted Arabic/transliterated terms.'
    )
    return F.when(n > MAX_EMPTY_PARENTHESES, c.matches("empty_parentheses", r"\(\)", lambda m: said)).otherwise(F.expr(NO_ERRORS))


@rule("length_mismatch")
def length_mismatch(c: Context) -> Column:
    sized = F.transform(c.segments, lambda s: F.struct(s.alias("s"), utf16_length(trim(F.coalesce(c.source_text(s["id"]), F.lit("")))).alias("source"), utf16_length(s["text"]).alias("own")))
    bad = F.filter(sized, lambda x: (x["source"] >= MIN_SOURCE_CHARS) & (x["own"] < MIN_RATIO * x["source"]))
    empty = lambda x: _say('Translation for "', x["s"]["id"], '" appears empty but arabic text has ', x["source"], " characters")
    short = lambda x: _say(
        'Translation for "', x["s"]["id"], '" appears truncated: ', x["own"], " chars for ", x["source"], " char arabic text (expected at least ~",
        F.floor(x["source"] * MIN_RATIO + 0.5), " chars)",
    )
    return F.transform(bad, lambda x: _plain(c, "length_mismatch", F.when(x["own"] == 0, empty(x)).otherwise(short(x)), x["s"]))


def _lexemes(text: Column) -> Column:
    """array<string>: words, and what stands between them."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{M}\p{Nd}'’.-]*|[^\p{L}]+"), F.lit(0))


def _in_capitals(x: Column) -> Column:
    return x.rlike(r"\A\p{L}") & x.rlike(r"[\p{Lu}\p{Lt}]") & ~x.rlike(r"\p{Ll}")


def caps_kinds(text: Column) -> Column:
    """array<string> of the kinds of a text's lexemes: c for a word all in capitals, s for white space of ASCII alone, o for others."""
    return F.transform(_lexemes(text), lambda x: F.when(x.rlike(r"\A[\t\n\f\r ]+\z"), "s").when(_in_capitals(x), "c").otherwise("o"))


def caps_runs(text: Column, least: int) -> Column:
    """array<struct<text, start, end>> of runs of at least so many all-capital words with white space alone between them."""
    empty = F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)")
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end"), empty.alias("out"))

    def close(acc: Column) -> Column:
        run = F.struct(F.substring(text, acc["start"] + 1, acc["end"] - acc["start"]).alias("text"), acc["start"].alias("start"), acc["end"].alias("end"))
        return F.when(acc["n"] >= least, F.concat(acc["out"], F.array(run))).otherwise(acc["out"])

    def add(acc: Column, x: Column) -> Column:
        caps = _in_capitals(x)
        space = x.rlike(rf"\A[{WS}]+\z")
        at = acc["at"] + F.length(x)
        return F.struct(
            at.alias("at"), F.when(caps, acc["n"] + 1).when(space, acc["n"]).otherwise(0).alias("n"),
            F.when(caps & (acc["n"] == 0), acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(caps, at).otherwise(acc["end"]).alias("end"),
            F.when(caps | space, acc["out"]).otherwise(close(acc)).alias("out"),
        )

    return F.aggregate(_lexemes(text), none, add, close)


@rule("all_caps")
def all_caps(c: Context) -> Column:
    return _each_segment(
        c, lambda s: caps_runs(s["text"], c.config.all_caps_words),
        lambda s, m: c.error("all_caps", _say('ALL CAPS detected: "', trim(m["text"]), '"'), m["text"], s["start"] + m["start"], s["start"] + m["end"], s["id"]),
    )


@rule("multiword_translit_without_gloss")
def translit_without_gloss(c: Context) -> Column:
    edge = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
    pattern = f"(?iu)(?<![{_WORD}])(al-{_TRANSLIT}+)[{WS}]+fi[{WS}]+(al-{_TRANSLIT}+){edge}"
    phrase = lambda m: F.concat(F.regexp_extract(m["text"], r"(?s)\A(\S+)", 1), F.lit(" fi "), F.regexp_extract(m["text"], r"(?s)(\S+)\z", 1))
    bare = lambda s, m: ~F.contains(F.substring(s["text"], m["start"] + 1, F.length(phrase(m)) + 25), F.lit("("))
    return _each_segment(
        c, lambda s: F.filter(spans(s["text"], pattern), lambda m: bare(s, m)),
        lambda s, m: c.error(
            "multiword_translit_without_gloss", _say('Multi-word transliteration without immediate gloss in "', s["id"], '": "', phrase(m), '"'), phrase(m),
            s["start"] + m["start"], s["start"] + m["start"] + F.length(phrase(m)), s["id"],
        ),
    )


def validate(df: DataFrame, *, response: str = "response", source: str = "source", config: Config = Config(), rules: Sequence[str | tuple[str, Rule]] | None = None) -> DataFrame:
    """df with normalized, segments (of the response) and errors.

    source is an array<struct<id, text>>. errors are in the rules' order; each has its rule's name as rule. A
    response without a marker has the one error no_valid_markers. Null responses count as empty.
    """
    chosen = [(r, RULES[r]) if isinstance(r, str) else r for r in (rules if rules is not None else RULES)]
    df = df.withColumn("normalized", normalize(F.coalesce(F.col(response), F.lit(""))))
    df = df.withColumn("segments", segments(F.col("normalized")))
    df = df.withColumns({"_segment_ids": index(F.transform("segments", lambda s: s["id"])), "_source_ids": index(F.transform(source, lambda s: s["id"]))})
    context = Context(F.col("normalized"), F.col("segments"), F.col(source), config, F.col("_segment_ids"), F.col("_source_ids"))
    named = lambda found, name: F.transform(found, lambda e: F.struct(F.lit(name).alias("rule"), e.alias("error")))
    flat = lambda found: F.transform(found, lambda x: F.struct(x["rule"].alias("rule"), *(x["error"][k].alias(k) for k in _FIELDS)))
    every = F.concat(*(named(f(context), name) for name, f in chosen)) if chosen else F.expr(f"cast(array() as array<struct<rule:string,error:{ERROR}>>)")
    raw = F.coalesce(F.col(response), F.lit(""))
    none = F.struct(F.lit("no_valid_markers").alias("type"), F.lit("No valid translation markers found").alias("message"), raw.alias("match"), F.lit(0).alias("start"), F.length(raw).alias("end"), *(F.lit(None).alias(k) for k in _FIELDS[5:])).cast(ERROR)
    return df.withColumn("errors", flat(F.when(F.size("segments") == 0, named(F.array(none), "no_valid_markers")).otherwise(every))).drop("_segment_ids", "_source_ids")


_FIELDS = ("type", "message", "match", "start", "end", "id", "segment_start", "segment_end")


def parsed_ids(response: Column) -> Column:
    return marker_ids(normalize(response))


def register_udtf(spark: SparkSession, name: str, handler: type) -> UserDefinedTableFunction:
    """A rule of a user's own as a Python table function: its eval(normalized, segments, source) yields (type, message, match, start, end, id,
    segment_start, segment_end), with nulls where it has nothing to say. It is registered for SQL under its name, too."""
    function = udtf(handler, returnType=ERROR)
    spark.udtf.register(name, function)
    return function


def error_rows(validated: DataFrame, keys: Sequence[str], source: str = "source", user_rules: Mapping[str, UserDefinedTableFunction] | None = None) -> DataFrame:
    """(keys ..., rule, type, message, match, start, end, id, segment_start, segment_end): the errors of validate() as rows, and those of table functions, which are
    joined laterally with normalized, segments and source. A response without a marker has no errors of table functions."""
    found = validated.select(*keys, F.explode_outer("errors").alias("e")).where("e is not null").select(*keys, "e.rule", *(f"e.{k}" for k in _FIELDS))
    for name, function in (user_rules or {}).items():
        call = function(F.col("normalized").outer(), F.col("segments").outer(), F.col(source).outer())
        own = validated.where(F.size("segments") > 0).select(*keys, "normalized", "segments", source).lateralJoin(call)
        found = found.unionByName(own.select(*keys, F.lit(name).alias("rule"), *_FIELDS))
    return found
