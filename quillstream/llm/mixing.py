"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the mix takes the point frac(i * golden ratio), in integers modulo 2**31. The point falls
into one source's share of the cumulative targets, and the slot's rank among that source's slots names
the block of equal word count that fills it. A source's blocks are cut from its documents in a hashed
order, laid end to end and repeated as often as the schedule asks (three times at most).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash

#: Points lie on a grid of this size; GOLDEN is the odd number next to GRID / golden ratio.
GRID, GOLDEN = 1 << 31, 1327217885
#: A document is used this often at most.
MAX_EPOCHS = 3
#: Sources are collected to the driver; more of them than this raises an error.
MAX_SOURCES = 100_000


def cycle_weights(n: int, weights: Sequence[int] = (5, 2, 1)) -> list[int]:
    return [weights[i % len(weights)] for i in range(n)]


def water_fill(sizes: Sequence[int], weights: Sequence[int], cap: int = MAX_EPOCHS) -> list[float]:
    """Targets that sum to all sizes, by weight, none above cap times its source's size."""
    total, capped = sum(sizes), {i for i, s in enumerate(sizes) if s == 0}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest, share = total - cap * sum(sizes[i] for i in capped), sum(weights[i] for i in free)
        above = {i for i in free if weights[i] * rest > cap * sizes[i] * share}
        if not above:
            return [float(cap * s) if i in capped else weights[i] * rest / share for i, s in enumerate(sizes)]
        capped |= above


def mix(
    docs: DataFrame, *, block_words: int = 32, seed: str = "mix", weigh: Callable[[int], Sequence[int]] = cycle_weights,
    chunk: int = 65_536, keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The schedule and the documents of a mix of docs(doc_id, text, source).

    Returns two tables. pieces(slot, source_no, doc_id, from_word, n_words): words from_word.. of a
    document that slot takes, so ordering by slot and position gives the mixed stream. documents(doc_id,
    size, source, source_size, target, taken): one row for each input row, whatever its doc_id. The columns
    of docs that keep names follow, unchanged.

    Sources are ordered by code point, null last, and weigh(n) gives their weights in that order. Null
    or wordless text has size 0 and is never taken; repeated doc_ids are separate rows of the order and
    take the same words together (each row's taken is its own). Rows that tie in every column are told
    apart by a row number. No input rows: both tables are empty. Extra columns don't matter.

    Ranks and running totals are two-level (within chunks of slots or buckets of documents, then over
    chunk totals), so a source with most of the rows is never in one task.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    sized = stash(docs.select("doc_id", F.col("source"), size.alias("size"), *kept).withColumn("row", F.monotonically_increasing_id()), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows"))
    found = totals.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["total"] for r in found]
    targets = water_fill(sizes, weigh(len(sizes)))
    plan = spark.createDataFrame(pa.table({
        "source_no": pa.array(range(len(found)), pa.int64()), "source": pa.array([r["source"] for r in found], pa.string()),
        "source_size": pa.array(sizes, pa.int64()), "target": pa.array(targets, pa.float64()),
    }))
    sized = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])

    ordered = _positions(sized.where("size > 0"), seed, sum(r["rows"] for r in found))
    total = sum(sizes)
    n_slots = -(-total // block_words)
    slots, asked = _slots(spark, n_slots, _bounds(targets, total), chunk)

    # each document, in each epoch, covers the blocks from its first word's to its last word's
    begin = F.col("begin") + F.col("epoch") * F.col("source_size")
    spread = (
        ordered.withColumn("epoch", F.explode(F.array(*(F.lit(i) for i in range(MAX_EPOCHS)))))
        .withColumn("at", begin)
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    )
    # blocks that no slot asks for go before they are shuffled
    spread = spread.join(F.broadcast(asked), "source_no").where("block < asked")
    low = F.greatest(F.col("at"), F.col("block") * block_words)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words, F.col("source_size") * MAX_EPOCHS)
    blocks = spread.select(
        "source_no", "block", "row", "doc_id", (low - F.col("at")).cast("long").alias("from_word"), (high - low).cast("long").alias("n_words")
    )
    pieces = slots.hint("merge").join(blocks, ["source_no", "block"])  # neither side is small
    pieces = pieces.select("slot", "source_no", "row", "doc_id", "from_word", "n_words")
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    documents = sized.hint("merge").join(taken, "row", "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        *(F.col(f"keep_{c}").alias(c) for c in keep),
    )
    return pieces.drop("row"), documents


def _bounds(targets: Sequence[float], total: int) -> list[int]:
    """Where each source's share of the grid begins, with the grid's end last."""
    sums = [0, *accumulate(int(x) for x in targets)]
    return [x * GRID // sums[-1] if total else 0 for x in sums]


def _chunk_slots(chunk_no: int, n_slots: int, bounds: Sequence[int], chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a chunk, and the source of each."""
    slot = np.arange(chunk_no * chunk, min(n_slots, (chunk_no + 1) * chunk), dtype=np.int64)
    return slot, np.searchsorted(np.array(bounds[1:]), slot % GRID * GOLDEN % GRID, side="right")


def _slots(spark: SparkSession, n_slots: int, bounds: Sequence[int], chunk: int) -> tuple[DataFrame, DataFrame]:
    """(slot, source_no, block), where block is the slot's rank among its source's slots, and (source_no, asked)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                source, n = np.unique(_chunk_slots(c, n_slots, bounds, chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(n), pa.int64()), pa.array(source, pa.int64()), pa.array(n, pa.int64())], names=["chunk", "source_no", "n"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slot, source = _chunk_slots(c, n_slots, bounds, chunk)
                block = np.empty(len(slot), np.int64)
                for b in before:
                    own = source == b["source_no"]
                    block[own] = b["offset"] + np.arange(own.sum())
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(source, pa.int64()), pa.array(block)], names=["slot", "source_no", "block"])

    counts = stash(spark.range(-(-n_slots // chunk)).mapInArrow(count, "chunk long, source_no long, n long"), "slots")
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    chunks = offsets.groupBy("chunk").agg(F.collect_list(F.struct("source_no", "offset")).alias("before"))  # one entry a source
    slots = chunks.mapInArrow(rank, "slot long, source_no long, block long")
    return slots, counts.groupBy("source_no").agg(F.sum("n").alias("asked"))


def shuffled_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _positions(sized: DataFrame, seed: str, rows: int, per_bucket: int = 4096) -> DataFrame:
    """sized with begin, its first word's place among its source's words in hashed order."""
    digits = 1
    while 16**digits * per_bucket < rows:
        digits += 1
    keyed = sized.withColumn("key", shuffled_key(F.col("doc_id"), seed)).withColumn("bucket", F.substring("key", 1, digits))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
        .select("source_no", "bucket", F.coalesce(F.sum("n").over(before("source_no").orderBy("bucket")), F.lit(0)).alias("offset"))
    )
    within = F.coalesce(F.sum("size").over(before("source_no", "bucket").orderBy("key", "row")), F.lit(0))
    return keyed.withColumn("inside", within).join(offsets, ["source_no", "bucket"]).select(
        "row", "doc_id", "size", "source_no", "source_size", (F.col("offset") + F.col("inside")).alias("begin")
    )
