"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar says which neighbouring characters belong to one unit. It becomes a zero-width regular expression that
matches between all others, so Spark's `split` cuts a text at every border and loses no character.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Grammar:
    """Units of a text. glued: pairs of character classes (as inside brackets); no border lies between a character of the
    first and one of the second. All other neighbours are in different units, so without pairs each code point is a unit."""

    glued: tuple[tuple[str, str], ...] = ()

    def border(self) -> str:
        """The pattern that matches, with no width, between any two units.

        Java tries every UTF-16 index: the third term keeps it out of surrogate pairs. The text's two ends never match.
        """
        inside = "".join(rf"(?!(?<=[{left}])[{right}])" for left, right in self.glued)
        return rf"(?s)(?<=.)(?=.)(?![\uDC00-\uDFFF]){inside}"


#: Runs of ASCII letters, and each other code point by itself.
LETTERS = Grammar((("A-Za-z", "A-Za-z"),))
#: Runs of ASCII white space, and runs of anything else.
SPACED = Grammar(((r"\x20\x09-\x0D", r"\x20\x09-\x0D"), (r"^\x20\x09-\x0D", r"^\x20\x09-\x0D")))
#: Lines, each with the \n that ends it.
LINES = Grammar(((r"^\n", r"^\n"), (r"^\n", r"\n")))
CODE_POINTS = Grammar()


@dataclass(frozen=True)
class Rates:
    """Of 100 hashed values, those below fim are transformed; of these, those below spm have the suffix first."""

    fim: int = 90
    spm: int = 20


def units(text: Column, grammar: Grammar) -> Column:
    """array<string>: the text's units in order. Splitting an empty text gives one empty piece, so that is taken apart."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.border()))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, from the sha256 of its decimal id; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _joined(pieces: Column, begin: Column, end: Column) -> Column:
    return F.array_join(F.slice(pieces, begin + 1, end - begin), "")


def transform(docs: DataFrame, grammar: Grammar = LETTERS, seed: int = 1, rates: Rates = Rates()) -> DataFrame:
    """docs(doc_id, text, ...) with n, form, prefix, middle, suffix and output.

    n: units of the text; form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); output: what a model
    is trained on. Both cuts lie between units, anywhere from before the first to after the last, and depend on doc_id, seed and n alone:
    repeated rows are cut alike, whatever the partitions. Null text counts as empty. Empty texts and texts that hold
    one of the markers stay plain, with null parts, so that output is never ambiguous. Added columns replace input columns of the
    same name (in any case); all others stay. Rows are worked out one by one: nothing is shuffled.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    step = row.select("_row", text.alias("_text"), *(h.alias(f"_h{k}") for k, h in enumerate(draws(F.col("_row.doc_id"), seed), 1)))
    step = step.withColumn("_units", units(F.col("_text"), grammar))
    step = step.withColumn("n", F.size("_units").cast("long"))
    marked = F.col("_text").rlike("|".join((PREFIX, SUFFIX, MIDDLE)))
    form = F.when((F.col("n") == 0) | marked | (F.col("_h3") % 100 >= rates.fim), PLAIN).when(F.col("_h4") % 100 < rates.spm, SPM).otherwise(PSM)
    cuts = [F.col(f"_h{k}") % (F.col("n") + 1) for k in (1, 2)]
    step = step.withColumns({"form": form, "_first": F.least(*cuts).cast("int"), "_second": F.greatest(*cuts).cast("int")})
    parts = {"prefix": (F.lit(0), "_first"), "middle": (F.col("_first"), "_second"), "suffix": (F.col("_second"), "n")}
    step = step.withColumns({
        name: F.when(F.col("form") != PLAIN, _joined(F.col("_units"), begin, F.col(end).cast("int"))) for name, (begin, end) in parts.items()
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    step = step.withColumn("output", F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(F.col("_text")))
    added = ("n", "form", "prefix", "middle", "suffix", "output")
    return step.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in added), *added)


def restored(output: Column, form: Column) -> Column:
    """The text again, from what transform() made of it. Markers don't overlap themselves and no part holds one, so cutting at
    markers gives the parts."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    """Lengths and hashes for each row of transform()."""
    return found.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
