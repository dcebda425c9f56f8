"""Substring dedup by relative Lempel-Ziv parsing.

A document is cut into passages: the words of all its windows in a row whose least 10-gram, their anchor, is the
same. Equal windows have equal anchors, so a window can only repeat inside the passages of its own anchor. These are
the reference block of that anchor, and route every passage to the one block that can hold it.

A passage that an earlier document has as a whole is one factor. Of equal passages the first is parsed for all: in
its block, against the suffix array of all passages of earlier documents, greedily into longest factors. Factors
of a window or more are duplicate spans; a window that straddles the border of two factors may stand in a third
document and is looked up in the index.

A block with very many words, as of a passage that stands in many surroundings, isn't one task's: there every
window is a reference block of its own, and its earliest holder is found by partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, mix, powers, signed, slices, small_batches, stash, text_key, window_hash, within

WINDOW, ANCHOR = 50, 10
#: Words of a reference block that one task indexes; larger ones are looked up window by window.
BLOCK_WORDS = 500_000
#: Smaller blocks are indexed together, up to about so many words.
TASK_WORDS = 200_000


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    if len(x) < n:
        return x[:0]
    span, least = 1, x
    while 2 * span <= n:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(x) - n + 1], least[n - span : n - span + len(x) - n + 1])


def _windows(tokens: Tokens, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all windows, each one's least anchor-gram, and the words' hashes."""
    words = tokens.hashes()
    starts = within(tokens, window)
    grams = mix(window_hash(words, anchor) + np.uint64(anchor))
    return starts, sliding_least(grams, window - anchor + 1)[starts], words


def _passages(window: int, anchor: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        tokens = Tokens(batch.column(2))
        starts, least, words = _windows(tokens, window, anchor)
        doc = tokens.document()[starts]
        head = np.ones(len(starts), bool)
        head[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(head)
        first, last, doc = starts[head], starts[np.append(head[1:], len(starts)) - 1] if len(head) else starts, doc[head]
        n = last - first + window
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(least[head])), pa.array(signed(_prints(words, first, n))), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(first - tokens.first[doc], pa.int32()), pa.array(n, pa.int32())],
            names=["anchor", "print", "doc_id", "key", "start", "n"],
        )


def _prints(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n words from each first on."""
    up, down = powers(len(words))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * up[: len(words)], dtype=np.uint64)])
    return mix((total[first + n] - total[first]) * down[first] + n.astype(np.uint64))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words, as hashes, of each passage that the document is the first to have and others may share parts of."""
    for batch in slices(batches):
        listed = batch.column(3)
        owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
        fields = pa.Table.from_struct_array(listed.flatten()) if len(owner) else None
        use = np.flatnonzero(fields["parse"].to_numpy()) if len(owner) else owner
        if not len(use):
            continue
        tokens = Tokens(batch.column(2))
        words = tokens.hashes()
        doc, start, n = owner[use], fields["start"].to_numpy()[use], fields["n"].to_numpy()[use]
        at = tokens.first[doc] + start
        yield pa.RecordBatch.from_arrays(
            [
                fields["anchor"].combine_chunks().take(pa.array(use)), fields["hot"].combine_chunks().take(pa.array(use)), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)),
                pa.array(start, pa.int32()), pa.array([words[i : i + k].tobytes() for i, k in zip(at, n)], pa.binary()),
            ],
            names=["anchor", "hot", "doc_id", "key", "start", "words"],
        )


def _window_prints(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a passage, for blocks that are too large for one task."""
    for batch in batches:
        for row in range(batch.num_rows):
            prints = window_hash(np.frombuffer(batch.column(4)[row].as_py(), np.uint64), window)
            places = np.arange(len(prints)) + batch.column(3)[row].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(prints)), *(pa.repeat(batch.column(c)[row], len(prints)) for c in (1, 2)), pa.array(places, pa.int32())], names=["print", "doc_id", "key", "start"]
            )


class Reference:
    """Passages of reference blocks, and for each of their words the longest factor from it on that a document before its own has.

    words: hashes; first: where each passage begins (the end last); block and doc: of each passage. Passages meet within their block.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, block: np.ndarray, doc: np.ndarray, window: int):
        n, levels = len(words), (window - 1).bit_length()
        sizes = np.diff(first)
        self.first, self.window, self.levels = first, window, levels
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.end = first[1:][self.owner]
        self.ranks = [self._dense(np.unique(block, return_inverse=True)[1][self.owner], np.unique(words, return_inverse=True)[1])]
        for level in range(levels):  # ranks of the 2 ** (level + 1) words from each place on; those that a passage's end cuts short are like no other
            step = 1 << level
            after = -1 - self.owner
            inside = np.flatnonzero(np.arange(n) + step < self.end)
            after[inside] = self.ranks[-1][inside + step]
            self.ranks.append(self._dense(self.ranks[-1], after))
        order = np.argsort(self.ranks[-1], kind="stable")  # the suffix array
        holder = doc[self.owner][order]
        self.length, self.source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for step in (-1, 1):  # the longest match is with the nearest suffix of an earlier document, on one side or the other
            near = self._nearest(holder[::step])
            near = near if step == 1 else np.where(near[::-1] >= 0, n - 1 - near[::-1], -1)
            some = np.flatnonzero(near >= 0)
            here, there = order[some], order[near[some]]
            length = self._common(here, there)
            better = length > self.length[here]
            self.length[here[better]], self.source[here[better]] = length[better], doc[self.owner[there[better]]]

    @staticmethod
    def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        low = low - low.min() if len(low) else low
        return np.unique(high.astype(np.int64) * (int(low.max()) + 1 if len(low) else 1) + low, return_inverse=True)[1]

    @staticmethod
    def _nearest(values: np.ndarray) -> np.ndarray:
        """For each value the nearest smaller one before it, -1 if there is none."""
        near = np.arange(len(values)) - 1
        todo = np.arange(len(values))
        while len(todo):
            todo = todo[(near[todo] >= 0) & (values[near[todo]] >= values[todo])]
            near[todo] = near[near[todo]]
        return near

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two places have in common, to 2 ** levels."""
        length = np.zeros(len(a), np.int64)
        for level in range(self.levels, -1, -1):
            some = np.flatnonzero((a + length < self.end[a]) & (b + length < self.end[b]) & (length < 1 << self.levels))
            rank = self.ranks[level]
            length[some[rank[(a + length)[some]] == rank[(b + length)[some]]]] += 1 << level
        return np.minimum(length, 1 << self.levels)

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All passages' greedy factors, as starts, ends and sources: each as long as any earlier document has it, or one word."""
        at, starts = self.first[:-1], []
        while len(at):
            starts.append(at)
            at = at + np.maximum(1, self.length[at])
            at = at[at < self.end[at - 1]]
        starts = np.concatenate(starts) if starts else self.first[:0]
        return starts, starts + np.maximum(1, self.length[starts]), self.source[starts]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Duplicate spans (start, end, source): factors of a window or more, and windows across factors' borders that the index holds."""
        start, end, source = self.parse()
        long = self.length[start] >= self.window
        edge = np.zeros(len(self.end) + 1, np.int64)  # windows that straddle the border at the end of a factor
        border = end[end < self.end[start]]
        np.add.at(edge, np.maximum(self.first[:-1][self.owner[border - 1]], border - self.window + 1), 1)
        np.add.at(edge, border, -1)
        at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.length >= self.window))
        found = [np.concatenate(x) for x in ((start[long], at), (end[long], at + self.window), (source[long], self.source[at]))]
        order = np.lexsort((found[1], found[0]))
        return tuple(x[order] for x in found)


def _parse(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; several whole blocks are indexed at once."""

    def index(rows: pa.Table) -> pa.RecordBatch:
        parts = [np.frombuffer(x, np.uint64) for x in rows["words"].to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        reference = Reference(np.concatenate(parts), first, rows["anchor"].to_numpy(), rows["doc_id"].to_numpy(), window)
        start, end, source = reference.spans()
        owner = reference.owner[start]
        shift = rows["start"].to_numpy()[owner] - first[owner]
        rows = rows.combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*(rows[c].chunk(0).take(pa.array(owner)) for c in ("doc_id", "key")), pa.array(start + shift, pa.int32()), pa.array(end + shift, pa.int32()), pa.array(source, pa.int64())],
            names=["doc_id", "key", "start", "end", "source"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, batch.num_rows)
        total = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(4)).to_numpy()) // 8])
        for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            if size >= TASK_WORDS and held[-1].column(0)[-1].as_py() != anchors[begin]:
                yield index(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(begin, end - begin))
            size += int(total[end] - total[begin])
    if held:
        yield index(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that no span covers."""
    out = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))
    for batch in batches:
        n_words, n_removed, kept, spans = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = text.encode().split() if text else []  # bytes.split() cuts at ASCII white space
            left, parsed = words, batch.column(2)[i].as_py() or []
            if parsed:
                parsed.sort(key=lambda f: (f["start"], f["end"]))
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [f["start"] for f in parsed], 1)
                np.add.at(gone, [f["end"] for f in parsed], -1)
                left = [w for w, k in zip(words, np.cumsum(gone).tolist()) if not k]
            n_words.append(len(words)), n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode()), spans.append(parsed)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, out)],
            names=["doc_id", "n_words", "n_removed", "kept_text", "factors"],
        )


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, factors): one row for each row of docs(doc_id, text).

    Every word goes that lies in a window of `window` words of its document whose word sequence also
    starts in a document with a smaller doc_id; windows are taken from the input, not from what is left.
    kept_text is the remaining words joined by one space; factors are array<struct<start, end, source>> in
    words, end exclusive, by start, which may overlap; source is an earlier document that holds the factor.

    A null, empty or short text (fewer words than a window) loses nothing; null has no words. Rows of one
    doc_id aren't earlier than each other, whatever their texts; each loses what smaller doc_ids have of it. Rows
    without a doc_id lose nothing, and no other row loses words to them. An empty table gives no rows. Extra
    columns aren't read. Words and passages are compared by 64-bit hashes.

    Blocks of more than block_words words are looked up window by window, with the same result.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), text_key().alias("key"), "text")
    # merge joins throughout: what Spark guesses of the size of Python output is far too low
    passages = docs.where("doc_id is not null").mapInArrow(lambda b: _passages(window, anchor, b), "anchor long, print long, doc_id long, key long, start int, n int")
    passages = stash(passages, "passages")
    prints = passages.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("anchor").alias("anchor"), F.first("n").alias("n"))
    blocks = prints.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("low"), F.max("last").alias("high"), F.sum("n").alias("size")).where("low < high")
    shared = prints.hint("merge").join(blocks, "anchor").where("kinds > 1 or first < last").select("print", "first", (F.col("kinds") > 1).alias("several"), (F.col("size") > block_words).alias("hot"))
    held = passages.hint("merge").join(shared, "print").where("several or first < doc_id")
    # what an earlier document holds whole is a factor; of the rest, the first holder's passages are parsed
    fields = F.struct("start", "n", "anchor", "hot", F.when(F.col("first") < F.col("doc_id"), F.col("first")).alias("source"), (F.col("first") == F.col("doc_id")).alias("parse"))
    # repeated rows have the same passages: each is kept, read and parsed once
    held = stash(held.groupBy("doc_id", "key").agg(F.collect_set(fields).alias("passages")), "held")

    asked = held.where(F.exists("passages", lambda p: p["parse"]))
    rows = docs.hint("merge").join(asked, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "passages")
    words = stash(rows.mapInArrow(_words, "anchor long, hot boolean, doc_id long, key long, start int, words binary"), "words")
    routed = words.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    parsed = routed.select("anchor", "doc_id", "key", "start", "words").mapInArrow(lambda b: _parse(window, b), "doc_id long, key long, start int, end int, source long")
    single = words.where("hot").select("anchor", "doc_id", "key", "start", "words").mapInArrow(lambda b: _window_prints(window, b), "print long, doc_id long, key long, start int")
    earliest = single.groupBy("print").agg(F.min("doc_id").alias("source"))
    looked_up = single.hint("merge").join(earliest, "print").where("source < doc_id").select("doc_id", "key", "start", (F.col("start") + window).alias("end"), "source")
    whole = held.select("doc_id", "key", F.explode("passages").alias("p")).where("p.source is not null").select("doc_id", "key", "p.start", (F.col("p.start") + F.col("p.n")).alias("end"), "p.source")
    found = whole.union(parsed).union(looked_up).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", "source")).alias("found"))
    rows = docs.hint("merge").join(found, ["doc_id", "key"], "left").select("doc_id", "text", "found")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,end:int,source:long>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
