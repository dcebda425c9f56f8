"""Corpus statistics and analytics over a segment table.

Segments: collection (excerpts, headings, footnotes), idx, id, nass, text, translator, last_updated_at (epoch
seconds), alt_count, patch_type. A text of '' counts as untranslated, though only null is queued for work.

All statistics take facts() as well, in which segments that none of them tells apart are one row with their number as
weight: facts of single files can be kept and added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import day_key, period_label, round_half_up, translators

COLLECTIONS = ("excerpts", "headings", "footnotes")
#: Translators that are shown one by one; beyond that the rest is one slice.
MAX_SLICES = 8
PATCH_LABELS = {"arabic_leak_correction": "Arabic Leak", "all_caps_correction": "All Caps"}


def is_translated(text: str = "text") -> Column:
    return F.coalesce(F.length(text), F.lit(0)) > 0


def collection_order(c: str = "collection") -> Column:
    return F.array_position(F.array(*map(F.lit, COLLECTIONS)), F.col(c)).cast("int")


def facts(segments: DataFrame, *by: str) -> DataFrame:
    """(by ..., collection, text, translator, last_updated_at, alt_count, patch_type, weight): how many segments are alike in all that statistics read.

    text is '' or one letter, times are cut to days. Facts of facts are their sums, so those of several files can be merged.
    """
    day = F.floor(F.col("last_updated_at") / 86_400).cast("long") * 86_400
    rows = segments.select(*by, "collection", F.when(is_translated(), "x").otherwise("").alias("text"), "translator", day.alias("last_updated_at"), "alt_count", "patch_type", _weight(segments).alias("weight"))
    return rows.groupBy(*(c for c in rows.columns if c != "weight")).agg(F.sum("weight").alias("weight"))


def _weight(rows: DataFrame) -> Column:
    return F.col("weight") if "weight" in rows.columns else F.lit(1).cast("long")


def _count(rows: DataFrame, cond: Column | None = None) -> Column:
    """The number of segments, or of those for which cond holds."""
    if "weight" not in rows.columns:
        return F.count(F.lit(1)) if cond is None else F.count_if(F.coalesce(cond, F.lit(False)))
    return F.coalesce(F.sum("weight" if cond is None else F.when(cond, F.col("weight"))), F.lit(0).cast("long"))


def counts(segments: DataFrame) -> DataFrame:
    """(collection, total, translated, untranslated)."""
    n = lambda cond=None: _count(segments, cond)
    return segments.groupBy("collection").agg(n().alias("total"), n(is_translated()).alias("translated"), n(~is_translated()).alias("untranslated"))


def stats(segments: DataFrame, created_at: int | None = None, last_updated_at: int | None = None) -> DataFrame:
    """One row: counts over excerpts and headings, distinct excerpt translators, and the work's duration in seconds."""
    both, excerpt = F.col("collection").isin("excerpts", "headings"), F.col("collection") == "excerpts"
    heading = F.col("collection") == "headings"
    n = lambda cond: _count(segments, cond)
    times = (F.lit(created_at).cast("long"), F.lit(last_updated_at).cast("long"))
    return segments.agg(
        n(both).alias("total_segments"), n(both & is_translated()).alias("translated_segments"), n(both & ~is_translated()).alias("untranslated_segments"),
        n(excerpt).alias("excerpts_total"), n(excerpt & is_translated()).alias("excerpts_translated"),
        n(heading).alias("headings_total"), n(heading & is_translated()).alias("headings_translated"),
        F.countDistinct(F.when(excerpt, F.col("translator"))).alias("unique_translators"),
    ).withColumns({"created_at": times[0], "last_updated_at": times[1], "work_duration_sec": F.when(times[0].isNotNull() & times[1].isNotNull(), F.greatest(F.lit(0), times[1] - times[0]))})


def distinct_translators(segments: DataFrame) -> DataFrame:
    """One row: of all excerpts, of all translated segments, and of excerpts with a translator other than 0."""
    return segments.agg(
        F.countDistinct(F.when(F.col("collection") == "excerpts", F.col("translator"))).alias("of_excerpts"),
        F.countDistinct(F.when(is_translated(), F.col("translator"))).alias("of_translated"),
        F.countDistinct(F.when((F.col("collection") == "excerpts") & (F.col("translator") != 0), F.col("translator"))).alias("of_snapshot"),
    )


def alternatives(segments: DataFrame) -> DataFrame:
    """(alt_count, label, segments): how many segments have so many alternative translations."""
    label = F.concat(F.col("alt_count").cast("string"), F.when(F.col("alt_count") == 1, " alt").otherwise(" alts"))
    return segments.where("alt_count > 0").groupBy("alt_count").agg(_count(segments).alias("segments")).select("alt_count", label.alias("label"), "segments").orderBy("alt_count")


def patch_types(segments: DataFrame) -> DataFrame:
    """(type, label, count) of the two kinds of correction."""
    label = F.element_at(F.create_map(*(F.lit(x) for pair in PATCH_LABELS.items() for x in pair)), F.col("type"))
    found = segments.where(F.col("patch_type").isin(*PATCH_LABELS)).groupBy(F.col("patch_type").alias("type")).agg(_count(segments).alias("count"))
    return found.select("type", label.alias("label"), "count").orderBy(F.desc("count"), "type")


def daily(segments: DataFrame) -> DataFrame:
    """(date, excerpts, headings) of translated excerpts and headings with a time."""
    use = is_translated() & F.col("collection").isin("excerpts", "headings") & F.col("last_updated_at").isNotNull()
    heading = F.col("collection") == "headings"
    return segments.where(use).groupBy(day_key(F.col("last_updated_at")).alias("date")).agg(_count(segments, ~heading).alias("excerpts"), _count(segments, heading).alias("headings"))


def timeline(segments: DataFrame) -> DataFrame:
    """(date, granularity, label, excerpts, headings, translated, cumulative_translated, completion_percent).

    Over more than 365 days the buckets are months, over more than 90 weeks from Monday, else days. The span is
    found from the daily buckets; the segments are read once for these and once for their number.
    """
    days = daily(segments)
    span = days.agg(F.datediff(F.max(F.to_date("date")), F.min(F.to_date("date"))).alias("gap")).select(
        F.when(F.col("gap") + 1 > 365, "month").when(F.col("gap") + 1 > 90, "week").otherwise("day").alias("granularity")
    )
    total = segments.agg(_count(segments, F.col("collection").isin("excerpts", "headings")).alias("total"))
    start = F.when(F.col("granularity") == "day", F.col("date")).otherwise(
        F.date_format(F.when(F.col("granularity") == "week", F.date_trunc("week", "date")).otherwise(F.date_trunc("month", "date")), "yyyy-MM-dd")
    )
    # one-row tables: the joins add a scalar
    buckets = days.join(F.broadcast(span)).groupBy(start.alias("date"), "granularity").agg(F.sum("excerpts").alias("excerpts"), F.sum("headings").alias("headings"))
    running = F.sum("translated").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # as many rows as periods
    out = buckets.withColumn("translated", F.col("excerpts") + F.col("headings")).withColumn("cumulative_translated", running).join(F.broadcast(total))
    return out.select(
        "date", "granularity", period_label(F.col("date"), F.col("granularity")).alias("label"), "excerpts", "headings", "translated", "cumulative_translated",
        round_half_up(F.col("cumulative_translated") / F.col("total") * 100, 1).alias("completion_percent"),
    ).orderBy("date")


def translator_shares(segments: DataFrame, slices: int = MAX_SLICES) -> DataFrame:
    """(rank, id, label, count, percent): translators of translated segments; beyond `slices`, the least used are one row `other`."""
    used = segments.where(is_translated() & F.col("translator").isNotNull()).groupBy(F.col("translator").cast("string").alias("id")).agg(_count(segments).alias("count"))
    everything = Window.partitionBy()  # as many rows as translators
    ranked = used.withColumns({
        "rank": F.row_number().over(Window.orderBy(F.desc("count"), "id")), "n": F.count(F.lit(1)).over(everything), "uses": F.sum("count").over(everything),
    })
    shown = (F.col("n") <= slices) | (F.col("rank") < slices)
    ranked = ranked.withColumns({"slot": F.when(shown, F.col("rank")).otherwise(slices), "key": F.when(shown, F.col("id")).otherwise("other")})
    grouped = ranked.groupBy("slot", "key").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("members"), F.max("uses").alias("uses"))
    named = grouped.join(F.broadcast(translators(segments.sparkSession)), grouped["key"] == F.col("id"), "left")
    label = F.when(F.col("key") == "other", F.concat(F.lit("Other ("), F.col("members").cast("string"), F.lit(")"))).otherwise(F.coalesce("label", F.concat(F.lit("Translator "), F.col("key"))))
    return named.select(
        F.col("slot").cast("int").alias("rank"), F.col("key").alias("id"), label.alias("label"), "count", round_half_up(F.col("count") / F.col("uses") * 100, 1).alias("percent")
    ).orderBy("rank")


def untranslated(segments: DataFrame) -> DataFrame:
    """The queue: segments whose text is null, excerpts before headings before footnotes."""
    return segments.where("text is null").withColumn("collection_order", collection_order()).select("collection_order", "idx", "collection", "id", "nass")


def duplicate_targets(segments: DataFrame) -> DataFrame:
    """(id, n, places) of ids that stand more than once; places are collection:idx in order."""
    place = F.struct(collection_order().alias("o"), "idx", F.concat_ws(":", "collection", F.col("idx").cast("string")).alias("p"))
    found = segments.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(place)).alias("at")).where("n > 1")
    return found.select("id", "n", F.array_join(F.transform("at", lambda x: x["p"]), ",").alias("places")).orderBy("id")
