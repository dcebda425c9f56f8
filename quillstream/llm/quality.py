"""Quality rules: line-first cleaning, in DataFrame functions only.

Every line is judged by itself (symbols, navigation, boilerplate, shouting, stutter, missing
punctuation). Failing lines are removed, then a document that lost too much of its text is rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

SYMBOLS = r"[#*$%&|<>]"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript",
    "sign up for our newsletter", "subscribe to our newsletter", "click here to", "lorem ipsum", "powered by", "skip to content",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of a line's words, lost_share of a document's."""

    symbol_share: float = 0.3
    separator_share: float = 0.15
    shout_share: float = 0.5
    stutter_share: float = 0.3
    open_words: int = 4  # a line of fewer words than this needs terminal punctuation
    boilerplate_words: int = 30  # a boilerplate phrase condemns a line of at most this many words
    lost_share: float = 0.3
    min_words: int = 50
    repeat_percent: int = 50


def line_fails(line: Column, line_words: Column, rules: Rules) -> Column:
    """Whether a line breaks one of the line rules; line_words are its words."""
    n = F.size(line_words)
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    # the characters of a class, without a string for each
    chars = lambda inside: F.length(F.regexp_replace(line, f"[^{inside}]+", ""))
    symbols = chars(SYMBOLS[1:-1]) >= rules.symbol_share * n
    navigation = count(r"(^|[\x20\x09])[|»›>·•/]([\x20\x09]|\z)") >= F.greatest(F.lit(2), rules.separator_share * n)
    boilerplate = (n <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
    shouting = (count(r"!!") >= rules.shout_share * n) | ((n >= 5) & (chars(r"\p{Lu}") > 0.6 * chars(r"\p{L}")))
    stutter = (n >= 5) & (F.size(F.filter(line_words, lambda w, i: w == F.get(line_words, i - 1))) >= rules.stutter_share * n)
    unpunctuated = (n < rules.open_words) & ~line.rlike(r"[.!?…。؟:;][\"'”’»)\]]*[\x20\x09-\x0D]*\z")
    return symbols | navigation | boilerplate | shouting | stutter | unpunctuated


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs(doc_id, text, ...) with clean_text, the base counts, base_failed and kept.

    Added columns replace input columns of the same name; all others stay. Null text counts as empty
    (no words, so base_failed). A line without a word is neither judged nor counted as lost and stays
    in clean_text; ties and repeated rows are each judged alone. Nothing is shuffled: each row is
    worked out by itself whatever its length.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # whatever its columns are called
    step = row.select("_row", F.col("_row.text").alias("_text"))
    text = F.coalesce(F.col("_text"), F.lit(""))
    step = step.withColumns({
        "_words": words(F.col("_text")),
        "_lines": F.split(text, "\n"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS[1:-1]}]+", "")).cast("long"),
    })
    step = step.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        # each line with its number of words and the verdict on it; one without a word is not judged
        "_judged": F.transform("_lines", lambda line: _let(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda w: F.struct(
            line.alias("line"), F.size(w).alias("n"), (F.when(F.size(w) > 0, line_fails(line, w, rules)).otherwise(F.lit(False))).alias("fails")))),
        "_grams": F.when(F.size("_words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        )).otherwise(F.expr("cast(array() as array<bigint>)")),
    })
    step = step.withColumn("_worded", F.transform(F.filter("_judged", lambda x: x["n"] > 0), lambda x: x["line"]))
    # only a text with a repeated hash pays for sorting its windows together with their places
    step = step.withColumn("_repeats", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    step = step.withColumn("_ranked", F.when(F.col("_repeats"), F.sort_array(
        F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("_ranked", j)["h"] == x["h"], F.lit(False))
    step = step.withColumn("_places", F.when(F.col("_repeats"), F.sort_array(F.transform(
        F.filter("_ranked", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))))
    gap = lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_places", j + 1) - p, F.lit(3)))
    step = step.withColumns({
        "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(F.col("_repeats"), F.aggregate(
            F.transform("_places", gap), F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("long"),
        "clean_text": F.array_join(F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
        "n_lost_words": F.aggregate(F.filter("_judged", lambda x: x["fails"]), F.lit(0), lambda a, x: a + x["n"]).cast("long"),
    })
    step = step.withColumns({
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")),
    })
    step = step.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= rules.lost_share * F.col("n_words")))
    added = [c for c in step.columns if not c.startswith("_")]
    return step.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in added), *added)
