import pytest
from pyspark.sql import functions as F

from quillstream.operators.rules import ERROR_TYPES, RULES, Config, validate


def errors(spark, response, source=(), **more):
    rows = spark.createDataFrame([(response, list(source))], "response string, source array<struct<id:string,text:string>>")
    return validate(rows, **more).first().errors


def of(found, kind):
    return [e for e in found if e.type == kind]


def test_no_markers_ends_the_matter(spark):
    found = errors(spark, "plain () () () () text")
    assert [(e.type, e.start, e.end) for e in found] == [("no_valid_markers", 0, 22)]
    assert [e.type for e in errors(spark, None)] == ["no_valid_markers"]


def test_arabic_leaks(spark):
    (leak,) = errors(spark, "P1 - hello بد world")
    assert (leak.match, leak.id, leak.segment_start, leak.segment_end, leak.rule) == ("بد", "P1", 6, 8, "arabic_leak")
    assert [e.match for e in errors(spark, "P1 - a مرحبا b\nP2 - c مع السلامة d")] == ["مرحبا", "مع السلامة"]
    assert errors(spark, "P1 - Muḥammad ﷺ said") == []


def test_all_caps_runs(spark):
    (run,) = errors(spark, "P1 - THEY BELIEVE IN AL-JIBT AND AL-ṬĀGHŪT")
    assert (run.match, run.segment_start, run.segment_end) == ("THEY BELIEVE IN AL-JIBT AND AL-ṬĀGHŪT", 0, 37)
    assert errors(spark, "P1 - ONE TWO THREE FOUR five") == [] and len(errors(spark, "P1 - ONE TWO x", config=Config(all_caps_words=2))) == 1
    assert errors(spark, "P1 - ONE TWO, THREE FOUR FIVE") == []  # the comma parts the run


def test_truncated_and_short(spark):
    source = [("P1", "س" * 60), ("P2", "…"), ("P3", "س" * 200)]
    found = errors(spark, "P1 - \nP2 - …\nP3 - [INCOMPLETE]", source)
    assert [e.id for e in of(found, "truncated_segment")] == ["P1", "P3"]
    assert [e.message for e in of(found, "length_mismatch")] == [
        'Translation for "P1" appears empty but arabic text has 60 characters',
        'Translation for "P3" appears truncated: 12 chars for 200 char arabic text (expected at least ~50 chars)',
    ]


def test_empty_parentheses_need_more_than_three(spark):
    assert of(errors(spark, "P1 - () () ()"), "empty_parentheses") == [] and len(of(errors(spark, "P1 - () () () ()"), "empty_parentheses")) == 4


@pytest.mark.parametrize(("line", "n"), [("P12$3 - x", 2), ("P1ab - x", 1), ("P1a x", 1), ("B12x5 - y", 2), ("P1 -", 1), ("P1 - fine", 0), ("P1a - fine", 0)])
def test_marker_format(spark, line, n):
    found = errors(spark, f"T1 - ok\n{line}")
    assert len(of(found, "invalid_marker_format")) == n


def test_newline_after_id(spark):
    assert [e.match for e in of(errors(spark, "P1 -\nText"), "newline_after_id")] == ["P1 -\n"]


def test_transliteration_needs_a_gloss(spark):
    assert [e.match for e in errors(spark, "P1 - he said al-hajr  fi al-madaji today")] == ["al-hajr fi al-madaji"]
    assert errors(spark, "P1 - al-hajr fi al-madaji (leaving the beds)") == [] and errors(spark, "P1 - xal-hajr fi al-madaji") == []


def test_rules_of_ones_own(spark):
    shout = lambda c: c.matches("shout", "!", lambda m: F.lit("loud"))
    (e,) = errors(spark, "P1 - hey! بد", rules=[("shout", shout)])
    assert (e.rule, e.type, e.id, e.segment_start) == ("shout", "shout", "P1", 3)
    assert errors(spark, "P1 - بد", rules=[]) == [] and set(RULES) <= set(ERROR_TYPES)


class LongWords:
    """A rule of a user's own: words of over 12 letters."""

    def eval(self, normalized, segments, source):
        for s in segments:
            for word in s["text"].split():
                if len(word) > 12:
                    at = s["text"].index(word)
                    yield "long_word", f"{word} is long", word, s["start"] + at, s["start"] + at + len(word), s["id"], at, at + len(word)


def test_table_functions_join_the_rules(spark):
    from quillstream.operators.rules import error_rows, register_udtf, validate

    rows = spark.createDataFrame([(1, "P1 - a conversational thing قال\nP2 - b", [("P1", "x"), ("P2", "y")]), (2, "no marker, incomprehensible", [])], "n int, response string, source array<struct<id:string,text:string>>")
    rule = register_udtf(spark, "long_words", LongWords)
    found = error_rows(validate(rows), ["n"], user_rules={"long_words": rule}).collect()
    assert sorted((r.n, r.rule) for r in found) == [(1, "arabic_leak"), (1, "long_words"), (2, "no_valid_markers")]
    own = next(r for r in found if r.rule == "long_words")
    assert (own.match, own.id, own.segment_start, own.start) == ("conversational", "P1", 2, 7)
    validate(rows).createOrReplaceTempView("validated")
    assert spark.sql("SELECT v.n, e.match FROM validated v, LATERAL long_words(v.normalized, v.segments, v.source) e").count() == 1
