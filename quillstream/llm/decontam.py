"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a partition's documents. Its words become numbers: those of the benchmark's own
vocabulary, and separators for all others (and between documents), since no test phrase crosses them.
Runs of words too short for any phrase drop out. Over the rest the shard gets a suffix array, its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All phrases are searched
backward at once by wavelet ranks; occurrences are located by walking to a sampled suffix, and their
word ranges merged into removal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Tokens, columns, slices, small_batches

WINDOW = 13
#: Characters of benchmark text in a block of phrases, of which a task holds one at a time: its arrays take about 25 bytes a character.
BLOCK_CHARS = 4_000_000
#: Every suffix whose place in its run is divisible by this keeps its text position.
SAMPLE = 8

SCHEMA = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


class Phrases:
    """The distinct windows of a block of benchmark items, as numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        tokens = Tokens(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS, fold=True)
        hashes, sizes = tokens.hashes(), np.diff(tokens.first)
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes).astype(np.int32) + 1
        count = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)  # windows of each item
        item = np.repeat(np.arange(len(items)), count)
        place = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(window, sizes[item])
        # padded with 0; padding can't be taken for a word
        rows = np.zeros((len(item), window), np.int32)
        for k in range(window):
            some = np.flatnonzero(length > k)
            rows[some, k] = numbers[(tokens.first[:-1][item] + place)[some] + k]
        self.windows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.length = (self.windows > 0).sum(axis=1)
        self.shortest = int(self.length.min()) if len(self.windows) else 0
        self.names = np.array(sorted({i for i, _ in items}), object)
        pairs = np.unique(np.stack([which.reshape(-1), np.searchsorted(self.names, [items[i][0] for i in item]) if len(item) else item]), axis=1)
        self.first, self.item = np.searchsorted(pairs[0], np.arange(len(self.windows) + 1)), pairs[1]
        # reversed for the backward search
        self.backward = np.zeros((len(self.windows), window), np.int32)
        for k in range(window):
            some = np.flatnonzero(self.length > k)
            self.backward[some, k] = self.windows[some, self.length[some] - 1 - k]

    def items(self, windows: np.ndarray) -> list[str]:
        """The ids, sorted, of the items that hold any of these windows."""
        return self.names[np.unique(np.concatenate([self.item[self.first[w] : self.first[w + 1]] for w in windows]))].tolist()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 if no benchmark item has it."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class WaveletMatrix:
    """Ranks over a sequence of numbers below 2**bits: for each bit, from the highest, the counts of ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.ones, self.zeros = [], []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int64)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~one], values[one]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(before)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = symbol >> bit & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            before = np.where(one, zeros + ones[before], before - ones[before])
        return before - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[at + 1] > ones[at]
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Over runs of numbers (1 and up); text has a 0 before each run and at its end."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = self._suffixes(text)
        symbols = text[order - 1]  # the last symbol, a separator, comes before the first
        self.bits = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(symbols, self.bits)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        run = np.arange(n) - np.maximum.accumulate(np.where(text == 0, np.arange(n), 0))  # place in the run, 1 for its first word
        keep = (run % SAMPLE == 1) | (text == 0)
        self.kept = keep[order]
        self.sampled = np.concatenate([[0], np.cumsum(self.kept)])
        self.position = order[self.kept]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array by doubling; separators differ from each other, in order of place, so no comparison passes one."""
        n, gaps = len(text), np.flatnonzero(text == 0)
        rank = text + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        span = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-span] = rank[span:] + 1 if span < n else 0
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            span *= 2
            if new[-1] == n - 1 or span >= n:
                return order

    def search(self, backward: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern; a row of backward holds a pattern from its end."""
        low, high = np.zeros(len(backward), np.int64), np.full(len(backward), len(self.kept), np.int64)
        active = np.arange(len(backward))
        for step in range(backward.shape[1]):
            active = active[(length[active] > step) & (high[active] > low[active])]
            if not len(active):
                break
            symbol = backward[active, step].astype(np.int64)
            known = symbol < 1 << self.bits
            high[active[~known]] = low[active[~known]]
            active, symbol = active[known], symbol[known]
            low[active] = self.less[symbol] + self.wavelet.rank(symbol, low[active])
            high[active] = self.less[symbol] + self.wavelet.rank(symbol, high[active])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes: back through the text to a sampled one. A run's first word is sampled, so no walk meets a separator."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = self.kept[rows[left]]
            done = left[here]
            out[done] = self.position[self.sampled[rows[done]]] + steps[done]
            left = left[~here]
            if len(left):
                symbol = self.wavelet.access(rows[left])
                rows[left] = self.less[symbol] + self.wavelet.rank(symbol, rows[left])
                steps[left] += 1
        return out


def search_shard(tokens: Tokens, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in a shard: the first word of each, and which phrase it is."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(tokens) or not len(phrases.windows):
        return none
    numbers = phrases.numbers(tokens.hashes())
    # runs of benchmark words inside one document, at least as long as the shortest phrase
    known = numbers > 0
    fresh = np.ones(len(numbers), bool)
    fresh[1:] = ~known[:-1]
    fresh[tokens.first[:-1][tokens.first[:-1] < len(numbers)]] = True
    run = np.cumsum(fresh)
    sizes = np.bincount(run[known], minlength=run[-1] + 1)
    use = np.flatnonzero(known & (sizes[run] >= phrases.shortest))
    if not len(use):
        return none
    head = np.concatenate([[True], run[use[1:]] != run[use[:-1]]])
    place = np.arange(len(use)) + np.cumsum(head)  # with a separator before each run
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = numbers[use]
    word = np.zeros(len(text), np.int64)
    word[place] = use
    index = FMIndex(text)
    low, high = index.search(phrases.backward, phrases.length)
    hit = np.flatnonzero(high > low)
    counts = (high - low)[hit]
    rows = np.repeat(low[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return word[index.locate(rows)], np.repeat(hit, counts)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as sorted ranges that don't touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[head], np.append(reach[np.flatnonzero(head)[1:] - 1], reach[-1])


def _scan(blocks: list[Broadcast], keep: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shard is searched for one block of phrases after the other; of several blocks a task holds one at a time."""
    for batch in slices(batches):
        tokens = Tokens(batch.column(1), ALNUM_WORDS, fold=True)
        starts, ends, items = ([[] for _ in range(batch.num_rows)] for _ in range(3))
        for block in blocks:
            phrases: Phrases = block.value
            first, which = search_shard(tokens, phrases)
            doc = np.searchsorted(tokens.first, first, side="right") - 1
            order = np.argsort(doc, kind="stable")
            first, which, doc = first[order], which[order], doc[order]
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for i in np.unique(doc).tolist():
                found = slice(cut[i], cut[i + 1])
                begin = first[found] - tokens.first[i]
                starts[i].append(begin), ends[i].append(begin + phrases.length[which[found]]), items[i].append(phrases.items(np.unique(which[found])))
            if len(blocks) > 1:
                vars(block).pop("_value", None)  # it is read from the local copy again when its turn comes
                del phrases
        spans = [merge(np.concatenate(s), np.concatenate(e)) if s else ([], []) for s, e in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.diff(tokens.first), pa.int64()), pa.array([s for s, _ in spans], pa.list_(pa.int32())),
                pa.array([e for _, e in spans], pa.list_(pa.int32())), pa.array([sorted({x for part in found for x in part}) for found in items], pa.list_(pa.string())), *batch.columns[2:],
            ],
            names=["doc_id", "n_words", "starts", "ends", "items", *keep],
        )


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[Phrases]:
    """The benchmark's windows in blocks; one block at a time passes the driver, as the queries of the search."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    for r in rows.orderBy("item", "text").toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            yield Phrases(block, window)
            block, size = [], 0
        block.append((r["item"] or "", r["text"]))
        size += len(r["text"])
    yield Phrases(block, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: Sequence[str] = (), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, spans, items) of docs(doc_id, text): one row for each input row.

    The columns of docs that keep names follow, unchanged; names of the result's own columns aren't taken.

    spans: array<struct<start, end>> of merged word ranges (end exclusive) that windows of benchmark
    (item_id, text) cover; items: the ids, as sorted strings, of the items with an occurring window. Null
    and empty texts have no words, no spans and no items; null item texts are ignored, a null item_id is an
    empty one; rows of docs with one doc_id, or none, each get their own row, repeated items count once. An
    item shorter than a window is one window of its own. Other columns aren't read. An empty benchmark finds
    nothing.

    Documents are never shuffled: each task indexes its own shards once for each block of block_chars
    characters of the benchmark, whose number changes no result.
    """
    schema = columns(docs, keep, SCHEMA)
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), "text", *(F.col(c).alias(f"keep_{c}") for c in keep))
    blocks = [docs.sparkSession.sparkContext.broadcast(x) for x in _blocks(benchmark, window, block_chars)]
    found = docs.mapInArrow(lambda batches: _scan(blocks, keep, batches), schema)
    return found.select("doc_id", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "items", *keep)


def digest(found: DataFrame) -> DataFrame:
    """The counts and the verdict for each row of contamination(), with the columns that were kept."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
        *(c for c in found.columns if c not in ("doc_id", "n_words", "spans", "items")),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
