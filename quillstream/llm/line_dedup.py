"""Line dedup by pairwise alignment.

Documents with the same lines form a class, led by its smallest doc_id. A class leader is paired, through
every shortest run of lines with enough words, with the earliest leader that has the run; the two are aligned
with patience diff, blocks that this leaves are looked for wherever they stand, and common blocks of enough
words are deleted from the later one. So a line goes if and only if it is in a block that an earlier leader has.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns, small_batches, stash, text_key

#: A line is rare if at most this share of all classes has it (or RARE_CLASSES of them, if that is more).
RARE_SHARE, RARE_CLASSES = 0.1, 10
#: Aligned blocks of fewer words stay.
MIN_WORDS = 8
_TRIM = " \t\r\x0b\x0c"


def patience(a: Sequence[int | None], b: Sequence[int | None]) -> list[tuple[int, int]]:
    """Aligned pairs of equal lines, increasing in both: common ends, then the longest increasing run of lines
    that are unique on both sides, then the same between these. None (a line without words) matches nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] is not None and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] is not None and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if b[j] is not None and right[b[j]] == 1}
        unique = [(i, place[a[i]]) for i in range(a0, a1) if left[a[i]] == 1 and a[i] in place]
        chain = _increasing(unique)
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        if chain:
            out += chain
            todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases on the right (they come sorted on the left), by piles."""
    tops: list[int] = []
    pile: list[int] = []  # index of each pile's top pair
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k : k + 1], pile[k : k + 1] = [j], [n]
        back.append(pile[k - 1] if k else -1)
    out, n = [], pile[-1] if pile else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def common_blocks(earlier: Sequence[int | None], later: Sequence[int | None], words: Sequence[int], min_words: int = MIN_WORDS) -> list[int]:
    """The lines of the later document in blocks (lines in a row on both sides) of min_words or more.

    Aligned blocks first; if that leaves lines which both have (repeated or moved ones), every block is
    looked for wherever it stands.
    """
    gone: set[int] = set()
    block: list[int] = []
    last = None
    for i, j in [*patience(earlier, later), (-2, -2)]:
        if block and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                gone.update(block)
            block = []
        block.append(j)
        last = (i, j)
    sizes = dict(zip(later, words))  # lines that the later document doesn't have end a run
    common = set(earlier) - {None}
    if any(x in common for k, x in enumerate(later) if k not in gone):
        have = {tuple(earlier[x:y]) for x, y in _runs(earlier, sizes, min_words)}
        for x, y in _runs(later, sizes, min_words):
            if tuple(later[x:y]) in have:
                gone.update(range(x, y))
    return sorted(gone)


def _runs(lines: Sequence[int | None], sizes: dict[int | None, int], min_words: int) -> Iterator[tuple[int, int]]:
    """The shortest runs of min_words from each line on and up to each line: they cover any longer run."""
    for step in (1, -1):
        for i in range(len(lines)):
            n, j = 0, i
            while 0 <= j < len(lines) and lines[j] is not None and lines[j] in sizes:
                n += sizes[lines[j]]
                if n >= min_words:
                    yield min(i, j), max(i, j) + 1
                    break
                j += step


def run_keys(lines: Column, words: Column, min_words: int = MIN_WORDS) -> Column:
    """Hashes of the shortest runs of lines with words that hold min_words, from each line on and up to each line.

    Any block of min_words that two documents share is covered by runs that both have.
    """
    state = lambda h, n: F.struct(h.cast("long").alias("h"), n.cast("int").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(x["line"].isNull(), state(acc["h"], F.lit(-1))).otherwise(state(F.xxhash64(acc["h"], x["line"]), acc["n"] + x["words"]))
        return F.when((acc["n"] < 0) | (acc["n"] >= min_words), acc).otherwise(more)

    def runs(rows: Column, seed: int) -> Column:
        def key(x: Column, i: Column) -> Column:  # every line of a run has a word: min_words lines are enough
            run = F.aggregate(F.slice(rows, i + 1, F.lit(min_words)), state(F.lit(seed), F.lit(0)), step, lambda acc: F.when(acc["n"] >= min_words, acc["h"]))
            return F.when(x["words"] >= min_words, x["line"]).when(x["line"].isNotNull(), run)

        return F.transform(rows, key)

    rows = F.zip_with(lines, words, lambda line, n: F.struct(line.alias("line"), n.alias("words")))
    return F.array_distinct(F.filter(F.concat(runs(rows, 1), runs(F.reverse(rows), 2)), lambda x: x.isNotNull()))


def _align(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [common_blocks(a, b, n, min_words) for a, b, n in zip(*(batch[c].to_pylist() for c in ("earlier", "later", "words")))]
        yield pa.RecordBatch.from_arrays([batch["class"], pa.array(rows, pa.list_(pa.int32()))], names=["class", "gone"])


def _delete(keep: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, removed = [], [], []
        for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist()):
            split = text.split("\n") if text is not None else []
            drop = set(gone or ())
            texts.append(text if not drop else "\n".join(x for i, x in enumerate(split) if i not in drop))
            lines.append(len(split)), removed.append(sorted(drop))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(lines, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(texts, pa.string()), *batch.columns[3:]],
            names=["doc_id", "n_lines", "removed_lines", "clean_text", *keep],
        )


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare_share: float | None = RARE_SHARE, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_lines, removed_lines, clean_text): one row for each row of docs(doc_id, text).

    The columns of docs that keep names follow, unchanged; names of the result's own columns aren't taken.

    removed_lines: array<int> of 0-based lines that are deleted. Lines are compared without white space at
    their ends; lines without a word match nothing, count for nothing and stay. Of documents with the same
    lines all but the smallest doc_id lose every line with words, if these hold min_words. Null text has no lines
    and stays null; an empty text has one, wordless, and stays. Rows of one doc_id aren't earlier than each other,
    whatever their texts, and each loses lines of its own; rows without a doc_id lose nothing and no other row loses
    a line to them. An empty table gives no rows; extra columns aren't read.

    Without a rare_share (as the queries run it) no line is too common: documents meet through every
    shortest run of lines that holds min_words, each with the run's earliest holder alone. The run itself is common
    to both, and every block of min_words that any earlier document shares is covered by such runs, so the result
    is that of aligning with all earlier documents, while pairs grow with the lines. With a rare_share they meet
    through rare lines alone, and a common line is removed only inside a block that a rare line led to.
    """
    schema = columns(docs, keep, "doc_id long, n_lines long, removed_lines array<int>, clean_text string")
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), "text", *kept)
    lines = F.split("text", "\n")
    has_word = lambda line: line.rlike(WORD)
    sequence = F.transform(lines, lambda line: F.when(has_word(line), F.xxhash64(F.btrim(line, F.lit(_TRIM)))))
    sized = F.transform(lines, lambda line: F.regexp_count(line, F.lit(WORD)))
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", text_key().alias("key"), sequence.alias("lines"), sized.alias("words"))
    rows = stash(rows.withColumn("class", F.md5(F.to_json("lines"))), "lines")
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("leader"))
    # a class's lines are read from one of the leader's rows; rows of other texts have classes of their own
    members = stash(rows.hint("merge").join(classes, "class").select("doc_id", "key", "class", "leader"), "classes")
    total = F.aggregate("words", F.lit(0), lambda a, n: a + n)
    worded = F.filter(F.transform("lines", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    copied = rows.hint("merge").join(classes, "class").where((F.col("doc_id") > F.col("leader")) & (total >= min_words)).select("doc_id", "key", worded.alias("gone"))

    leaders = rows.hint("merge").join(classes, "class").where("doc_id = leader").select("class", "leader", "lines", "words").dropDuplicates(["class"])
    leaders = stash(leaders, "leaders")
    if rare_share is None:
        held = leaders.select("class", "leader", F.explode(run_keys(F.col("lines"), F.col("words"), min_words)).alias("line"))
    else:
        held = leaders.select("class", "leader", F.explode(F.array_distinct("lines")).alias("line")).where("line is not null")
    # the earliest holder by partial sums, so that a very common line is no task's alone
    first = held.groupBy("line").agg(F.min(F.struct("leader", "class")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if rare_share is not None:
        first = first.where(F.col("n") <= max(RARE_CLASSES, int(rare_share * leaders.count())))
    first = first.select("line", F.col("first.leader").alias("first_leader"), F.col("first.class").alias("first"))
    pairs = held.hint("merge").join(first, "line").where("leader > first_leader").select("class", "first").distinct()
    pairs = pairs.hint("merge").join(leaders.select("class", F.col("lines").alias("later"), "words"), "class")
    pairs = pairs.hint("merge").join(leaders.select(F.col("class").alias("first"), F.col("lines").alias("earlier")), "first").select("class", "earlier", "later", "words")
    aligned = pairs.mapInArrow(lambda b: _align(min_words, b), "class string, gone array<int>").where(F.size("gone") > 0)
    led = members.where("doc_id = leader").select("doc_id", "key", "class").distinct()
    aligned = led.hint("merge").join(aligned, "class").select("doc_id", "key", "gone")

    gone = aligned.union(copied.select("doc_id", "key", F.col("gone").cast("array<int>")))
    gone = gone.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    rows = docs.withColumn("key", text_key()).hint("merge").join(gone, ["doc_id", "key"], "left")
    return rows.select("doc_id", "text", "gone", *(f"keep_{c}" for c in keep)).mapInArrow(lambda b: _delete(keep, b), schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed_lines"),
        F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"),
    )
