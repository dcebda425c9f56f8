"""Aligning a response's segments with those of its prompt, and the errors of that alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.arrays import among, count, index, let
from ..functions.overlap import best_overlap


def ids(parsed: Column) -> Column:
    return F.transform(parsed, lambda s: s["id"])


def duplicate_ids(found: Column) -> Column:
    """array<struct<id, n>> of ids that stand more than once, by first appearance."""
    counted = lambda names: F.transform(F.array_distinct(found), lambda x: F.struct(x.alias("id"), count(names, x).alias("n")))
    return F.filter(let(index(found), counted), lambda c: c["n"] > 1)


def invented_ids(expected: Column, found: Column) -> Column:
    """Every occurrence of an id that the source doesn't have."""
    return among(found, expected, wanted=False)


def missing_ids(expected: Column, found: Column) -> Column:
    return among(expected, found, wanted=False)


def first_out_of_order(expected: Column, found: Column) -> Column:
    """struct<position, expected, received> of the first place, from 1, where both have an id and these differ."""
    n = F.least(F.size(expected), F.size(found))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    bad = F.filter(places, lambda i: F.get(expected, i - 1) != F.get(found, i - 1))
    at = F.get(bad, F.lit(0))
    return F.when(at.isNotNull(), F.struct(at.alias("position"), F.get(expected, at - 1).alias("expected"), F.get(found, at - 1).alias("received")))


def alignment_errors(expected: Column, found: Column, odd: Column) -> Column:
    """array<struct<type, id, message, match>>: duplicates, inventions, what is missing, and the first id out of order.

    odd is a column with first_out_of_order(expected, found).
    """
    row = lambda kind, key, message, match: F.struct(F.lit(kind).alias("type"), key.cast("string").alias("id"), message.alias("message"), match.alias("match"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    twice = F.transform(duplicate_ids(found), lambda c: row("duplicate_id", c["id"], say('Duplicate translated ID "', c["id"], '" found ', c["n"], " times in the response."), c["id"]))
    made = F.transform(invented_ids(expected, found), lambda x: row("invented_id", x, say('Translated response contains ID "', x, '" which does not exist in the Arabic source.'), x))
    gone = F.array_join(missing_ids(expected, found), ", ")
    lost = F.filter(F.array(row("missing_id_gap", F.lit(None), say("Translated response is missing source IDs: ", gone, "."), gone)), lambda e: e["match"] != "")
    said = say("Translated response is out of order at position ", odd["position"], ': expected "', odd["expected"], '", received "', odd["received"], '".')
    moved = F.filter(F.array(row("missing_id_gap", odd["received"], said, odd["received"])), lambda e: e["match"].isNotNull())
    return F.concat(twice, made, lost, moved)


def exact_block(prompt: Column, found: Column) -> Column:
    """Where, from 0, the prompt's ids last hold the response's in a row; null if nowhere. Ids have no line break in them.

    The lists are compared as texts of one id a line, read from the back.
    """
    lines = lambda a: F.concat(F.lit("\n"), F.array_join(a, "\n"), F.lit("\n"))

    def before(texts: Column) -> Column:
        at = F.call_function("locate", F.reverse(texts["found"]), F.reverse(texts["prompt"]))
        head = F.substring(texts["prompt"], F.lit(1), F.length(texts["prompt"]) - (at - 1) - F.length(texts["found"]))
        return F.when(at > 0, F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))))

    texts = F.struct(lines(prompt).alias("prompt"), lines(found).alias("found"))
    return F.when((F.size(found) > 0) & (F.size(prompt) >= F.size(found)), let(texts, before))


@pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def overlap_range(prompt: pd.Series, found: pd.Series) -> pd.DataFrame:
    ranges = [best_overlap(list(p), list(f)) if p is not None else None for p, f in zip(prompt, found)]
    return pd.DataFrame({"start": [r[0] if r else None for r in ranges], "end": [r[1] if r else None for r in ranges]}).astype("Int32")


# not to be copied into the lambdas of later steps, where Python can't run
overlap_range = overlap_range.asNondeterministic()


def align(df: DataFrame, prompt: str = "prompt_segments", response: str = "segments") -> DataFrame:
    """df with source (the prompt segments that the response answers) and aligned.

    A block of the prompt with exactly the response's ids is looked for first; only rows without one are
    searched for the best overlap, in Python (all others are null to it). Rows where that finds nothing, or whose response has more segments than
    the prompt or none, get all of the prompt's segments.
    """
    rows = df.withColumn("_exact", exact_block(ids(F.col(prompt)), ids(F.col(response))))
    small = (F.size(response) > 0) & (F.size(prompt) >= F.size(response))
    search = F.col("_exact").isNull() & small
    rows = rows.withColumn("_range", overlap_range(F.when(search, ids(F.col(prompt))), F.when(search, ids(F.col(response)))))
    block = F.struct(F.col("_exact").alias("start"), (F.col("_exact") + F.size(response)).alias("end"))
    out = rows.withColumn("_range", F.when(F.col("_exact").isNotNull(), block).otherwise(F.col("_range")))
    found = F.col("_range.start").isNotNull()
    part = F.slice(F.col(prompt), F.col("_range.start") + 1, F.col("_range.end") - F.col("_range.start"))
    return out.withColumns({"source": F.when(found, part).otherwise(F.col(prompt)), "aligned": found}).drop("_exact", "_range")
