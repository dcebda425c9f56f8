"""Packing untranslated work into token budgets, and the work queue's pages, groups and checkpoints.

A queue has collection_order, idx (its order), id and nass; see corpus.untranslated().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..functions.values import Estimator, estimate_tokens
from .running import beside, positions, ranks, running_sums

# fixed values: the groups of the token limits and the defaults of the pages and payloads
TOKEN_LIMITS = (("5k", 5_000), ("11k", 11_000), ("16k", 16_000), ("all", None))
PAGE_SIZE, MAX_PAGE_SIZE, MAX_IDS, MAX_MAX_IDS = 5, 100, 500, 2_000
PAYLOAD_TOKENS, MAX_PAYLOAD_TOKENS, PAYLOAD_ITEMS, MAX_PAYLOAD_ITEMS = 4_000, 200_000, 10_000, 100_000
_ORDER = {"place": "idx", "within": ["collection_order"]}
_KEYS = ["collection_order", "idx"]


def line(prefix: str = "id", text: str = "nass") -> Column:
    return F.concat(F.col(prefix), F.lit(" - "), F.coalesce(F.col(text), F.lit("")))


def overhead(chars: int) -> Column:
    return F.ceil((F.length("id") + chars) / 4)


def token_groups(queue: DataFrame, base_tokens: int = 0, estimate: Estimator = estimate_tokens) -> DataFrame:
    """queue with tokens, running (from base_tokens) and group_no: the first limit that holds the running total."""
    cost = estimate(F.coalesce("nass", F.lit(""))) + overhead(5)
    rows = running_sums(queue.withColumn("tokens", cost.cast("long")), {"running": F.col("tokens"), "position": F.lit(1)}, _KEYS)
    rows = rows.withColumn("running", F.col("running") + base_tokens)
    number = F.lit(len(TOKEN_LIMITS) - 1)
    for i, (_, limit) in reversed(list(enumerate(TOKEN_LIMITS[:-1]))):
        number = F.when(F.col("running") <= limit, i).otherwise(number)
    return rows.withColumn("group_no", number)


def group_summary(spark: SparkSession, grouped: DataFrame) -> DataFrame:
    """(group_no, label, limit, ids, tokens, last_index): a row for every group; last_index is -1 for an empty one."""
    dim = spark.createDataFrame([(i, label, limit) for i, (label, limit) in enumerate(TOKEN_LIMITS)], "group_no int, label string, limit long")
    found = grouped.groupBy("group_no").agg(F.count(F.lit(1)).alias("ids"), F.sum("tokens").alias("tokens"), (F.max("position") - 1).alias("last_index"))
    return dim.join(found, "group_no", "left").select("group_no", "label", "limit", *(F.coalesce(c, F.lit(d).cast("long")).alias(c) for c, d in (("ids", 0), ("tokens", 0), ("last_index", -1)))).orderBy("group_no")


def budget(queue: DataFrame, max_tokens: int, prompt: str = "", estimate: Estimator = estimate_tokens, cost: Column | None = None, max_items: int | None = None) -> DataFrame:
    """The longest prefix of the queue that fits: position, tokens, running.

    Costs are never negative, so the prefix is where the running total stays within the budget. A prompt
    above the budget takes nothing. max_items bounds the prefix before any total is made.
    """
    base = estimate(trim(F.lit(prompt)))
    if max_items is not None:
        queue = queue.orderBy("collection_order", "idx").limit(max_items)
    cost = estimate(line()) if cost is None else cost
    rows = running_sums(queue.withColumn("tokens", cost.cast("long")), {"running": F.col("tokens"), "position": F.lit(1)}, _KEYS)
    return rows.withColumn("running", F.col("running") + base).where((F.col("running") <= max_tokens) & (base <= max_tokens))


def payload(queue: DataFrame, max_tokens: int = PAYLOAD_TOKENS, prompt: str = "", max_items: int = PAYLOAD_ITEMS, estimate: Estimator = estimate_tokens) -> DataFrame:
    """One row (payload, item_count, used_tokens): the prompt and the lines that fit. Only excerpts are packed."""
    max_tokens, max_items = min(max_tokens, MAX_PAYLOAD_TOKENS), min(max_items, MAX_PAYLOAD_ITEMS)
    cost = estimate(F.coalesce("nass", F.lit(""))) + overhead(4)
    taken = budget(queue.where("collection_order = 1"), max_tokens, prompt, estimate, cost, max_items)
    return _joined(taken, prompt, estimate, "\n", True)


def shift(queue: DataFrame, max_tokens: int, prompt: str = "", estimate: Estimator = estimate_tokens) -> DataFrame:
    """One row (payload, item_count, used_tokens) of the next batch of all collections."""
    taken = budget(queue, max_tokens, prompt, estimate)
    out = _joined(taken, prompt, estimate, "\n\n" if prompt.strip() else "\n", False)
    over = estimate(trim(F.lit(prompt))) > max_tokens
    return out.select(F.when(over, "").otherwise(F.col("payload")).alias("payload"), "item_count", F.when(over, 0).otherwise(F.col("used_tokens")).alias("used_tokens"))


def _joined(taken: DataFrame, prompt: str, estimate: Estimator, glue: str, always: bool) -> DataFrame:
    """The lines of a batch, which the token budget bounds, as one text."""
    head = trim(F.lit(prompt))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line().alias("line")))), lambda x: x["line"]), glue)
    rows = taken.agg(lines.alias("lines"), F.count(F.lit(1)).alias("item_count"), F.sum("tokens").alias("tokens"))
    both = F.concat(head, F.lit("\n\n"), "lines")
    text = F.when(head == "", F.col("lines")).when(F.lit(always) | (F.col("item_count") > 0), both).otherwise(head)
    return rows.select(text.alias("payload"), "item_count", (F.coalesce("tokens", F.lit(0)) + estimate(head)).alias("used_tokens"))


def page(queue: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of the queue with position, page, total_pages and total; the page is clamped to those there are."""
    size = max(1, min(size, MAX_PAGE_SIZE))
    total = queue.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))
    total = total.withColumn("page", F.least(F.greatest(F.lit(1), F.lit(number)), F.col("total_pages")))
    rows = positions(queue, **_ORDER).join(F.broadcast(total))  # one row
    return rows.where((F.col("position") > (F.col("page") - 1) * size) & (F.col("position") <= F.col("page") * size))


def head_ids(queue: DataFrame, max_ids: int = MAX_IDS) -> DataFrame:
    return queue.orderBy("collection_order", "idx").limit(min(max_ids, MAX_MAX_IDS)).select("id")


def picked(queue: DataFrame, end_index: int | None, max_ids: int = MAX_IDS) -> DataFrame:
    """(position, id, nass) of the displayed ids up to and including end_index, from 0; of a repeated id the last item's nass. None picks nothing."""
    shown = positions(queue.orderBy("collection_order", "idx").limit(min(max_ids, MAX_MAX_IDS)), **_ORDER).select("position", "id")
    picked_ids = shown.where(F.col("position") <= (-1 if end_index is None else end_index) + 1)
    # only items of the few ids that are shown
    items = queue.join(F.broadcast(picked_ids.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.max_by("nass", F.struct("collection_order", "idx")).alias("nass"))
    return picked_ids.join(items, "id").select("position", "id", "nass")


def whole_number(value: str | None, default: int, most: int | None = None, least: int = 1) -> int:
    """A parameter as a whole number; the default where it is none or below least, and never above most."""
    try:
        number = int(str(value).strip())
    except ValueError:
        number = default
    number = default if number < least else number
    return number if most is None else min(number, most)


def neighbours(queue: DataFrame) -> DataFrame:
    """(id, prev_id, next_id) in queue order."""
    return beside(queue.select(*_KEYS, "id"), "id", _KEYS).select("id", F.col("prev").alias("prev_id"), F.col("next").alias("next_id"))


def chunks(rows: DataFrame, size: int, *, place: str, within: Sequence[str] = ()) -> DataFrame:
    """rows with chunk_no, in request chunks of so many."""
    return positions(rows, "_n", place=place, within=within).withColumn("chunk_no", F.floor((F.col("_n") - 1) / size)).drop("_n")


def resume(queue: DataFrame, shifted_ids: DataFrame | None = None, shifted_count: int = 0) -> DataFrame:
    """What is left of the queue after a checkpoint: by its ids if there are any, else by its count."""
    if shifted_ids is not None and not shifted_ids.isEmpty():
        return queue.join(shifted_ids.select("id").distinct(), "id", "left_anti").select(*queue.columns)
    gone = positions(queue, **_ORDER).where(F.col("position") <= max(0, shifted_count)).select("id").distinct()
    return queue.join(gone, "id", "left_anti").select(*queue.columns)


def checkpoint_matches(version: int | None, checkpoint_mtime_ms: float | None, source_mtime_ms: float) -> bool:
    """Whether a checkpoint is of this source: version 1 and the same time in whole milliseconds."""
    return version == 1 and checkpoint_mtime_ms is not None and int(checkpoint_mtime_ms) == int(source_mtime_ms)


def first_seen(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with is_first: the first of each key in the given order, which has no ties."""
    return ranks(rows, [key], order, "_rank").withColumn("is_first", F.col("_rank") == 1).drop("_rank")
