import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import values as V


def one(spark, column, **values):
    """The value of a column over one row."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values) or None) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("helloP1 - x", "hello\nP1 - x"), ("hello P1 - x", "hello\nP1 - x"), ("P1 - One\\[two]", "P1 - One[two]"), ("a\r\nb\rc", "a\nb\nc"), ("xP1 - aP2b – b", "x\nP1 - a\nP2b – b"),
        ("no marker", "no marker"), ("", ""), ("P12 x P13- y", "P12 x\nP13- y"),
    ],
)
def test_normalize(spark, given, wanted):
    assert one(spark, T.normalize(F.col("t")), t=given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("P1 - a\nP2b - b", [("P1", "a"), ("P2b", "b")]), ("intro\nP1 - a\nmore\n\nP1 - c", [("P1", "a\nmore"), ("P1", "c")]), ("B100j — x", [("B100j", "x")]), ("", []), ("X1 - no", []),
        ("P1 -", [("P1", "")]), ("P1 - a\nP2 - \nP3 - c", [("P1", "a"), ("P2", ""), ("P3", "c")]), ("P1 -  nbsp ", [("P1", "nbsp")]),
    ],
)
def test_segments(spark, given, wanted):
    rows = one(spark, T.segments(T.normalize(F.col("t"))), t=given)
    assert [(r.id, r.text) for r in rows] == wanted
    normal = one(spark, T.normalize(F.col("t")), t=given)
    assert all(normal[r.start : r.end] == r.text and normal[r.head :].startswith(r.id) for r in rows)


def test_segments_survive_serializing(spark):
    text = "P1 - one\n\nP2a - two\nlines\n\nT3 - three"
    parsed = T.segments(T.normalize(F.col("t")))
    assert one(spark, T.serialize(parsed), t=text) == text


def test_last_of_a_repeated_id_wins_in_the_map(spark):
    assert one(spark, T.segment_map(T.segments(T.normalize(F.col("t")))), t="P1 - a\nP2 - b\nP1 - c") == {"P1": "c", "P2": "b"}


def test_spans_and_occurrences(spark):
    assert [tuple(r) for r in one(spark, T.spans(F.col("t"), r"\d+"), t="12ab3😀45")] == [("12", 0, 2), ("3", 4, 5), ("45", 6, 8)]
    assert one(spark, T.spans(F.col("t"), "z"), t="abc") == []
    assert one(spark, T.occurrences(F.col("t"), F.lit("aa")), t="aaaa") == 2 and one(spark, T.occurrences(F.col("t"), F.lit("")), t="aaaa") == 0


def test_trim_and_lengths(spark):
    assert one(spark, T.trim(F.col("t")), t=" ﻿\n x y  \t") == "x y"
    assert one(spark, T.utf16_length(F.col("t")), t="a😀") == 3 and one(spark, T.is_blank(F.col("t")), t="  ")


def test_speaker_labels(spark):
    text = "Questioner: a\nThe Shaykh: b\nQuestioner: c\nOnce: d\nThe Shaykh: e"
    assert one(spark, T.speaker_labels(F.col("t")), t=text) == ["Questioner", "The Shaykh"]
    assert T.label_pattern(["A.b"]).startswith(r"(?:A\.b") and T.punctuation_pattern([".", "?"]) == r"\.|\?"


def test_models(spark):
    for name, kind in (("gpt-5", "ChatGPT"), ("o3-mini", "ChatGPT"), ("chatgpt-x", "ChatGPT"), ("gemini-2.5-pro", "Gemini"), ("bard", "Gemini"), ("grok-2", "Grok"), ("llama", "Unknown")):
        assert one(spark, V.provider(F.col("t")), t=name) == kind
    assert one(spark, V.model_name(F.col("t")), t=" Auto ") is None and one(spark, V.model_name(F.col("t")), t=" gpt ") == "gpt"
    assert one(spark, V.translator_id(F.col("t")), t="gpt-5-4-pro") == 903 and one(spark, V.translator_id(F.col("t")), t="other") is None


def test_numbers_and_dates(spark):
    assert one(spark, V.round_half_up(F.lit(66.65), 1)) == 66.7 and one(spark, V.round_half_up(F.lit(2 / 3 * 100), 1)) == 66.7
    assert [one(spark, V.thinking_bucket(F.lit(x).cast("double"))) for x in (0, 9.9, 10, 30, 60, -1, None, float("nan"))] == ["lt_10s", "lt_10s", "10_to_30s", "30_to_60s", "1m_plus", None, None, None]
    assert one(spark, V.iso_seconds(F.col("t")), t="2026-01-02T00:00:00.900Z") == 1767312000 and one(spark, V.iso_seconds(F.col("t")), t="soon") is None
    assert one(spark, V.iso_text(F.lit(1.5))) == "1970-01-01T00:00:01.500Z" and one(spark, V.duration_text(F.lit(93_784))) == "1d 2h 3m" and one(spark, V.duration_text(F.lit(5))) == "0m"
    assert one(spark, V.day_key(F.lit(1767312000))) == "2026-01-02" and one(spark, V.estimate_tokens(F.lit("12345"))) == 2
    assert V.translators(spark).count() == 8
