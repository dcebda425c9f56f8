"""Language identification, words first, with back-off to character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored
by the longest character n-grams of it that are known (five characters, then four, ... one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, slices, small_batches

#: About this many labelled documents, chosen by a hash of doc_id, are learned from.
TRAIN_DOCS = 20_000
#: Words and n-grams that a model may hold in all, over all languages and lengths: bounds what is broadcast.
MAX_ENTRIES = 200_000
#: Entries times languages, four bytes each: with very many languages there are fewer entries.
MAX_CELLS = 25_000_000
MAX_LANGUAGES = 1_000
#: Parts of a language's entries of one length that are ranked on their own first.
PARTS = 16
LONGEST = 5
UNDETERMINED = "und"
#: The score is the posterior of a text of so many words with the same average evidence (or fewer, if it has fewer).
SCORE_WORDS = 20
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words whose scores a task remembers, and the bytes these may take.
_CACHE_WORDS, _CACHE_BYTES = 250_000, 16_000_000


@dataclass
class Model:
    languages: list[str]
    entries: dict[str, int]  # a word as "=word", an n-gram as itself; padded words begin and end with a space
    scores: np.ndarray  # float32[entry, language]

    def word(self, word: str) -> np.ndarray:
        """Log scores of a word in every language; 0 everywhere if nothing of it is known."""
        at = self.entries.get("=" + word)
        if at is not None:
            return self.scores[at]
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            known = [self.entries[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in self.entries]
            if known:
                return self.scores[known].mean(axis=0) * (n / LONGEST)
        return np.zeros(len(self.languages), np.float32)


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; documents of bucket 0 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, max_entries: int = MAX_ENTRIES) -> Model:
    """A model of labelled(doc_id, text, lang); rows without a lang or a letter teach nothing.

    All counting is done by Spark; only the bounded tables of the model come to the driver.
    """
    labelled = labelled.where("lang is not null and text is not null")
    n = labelled.count()
    grid = 1 << 30
    share = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(grid)) < min(grid, int(grid * train_docs / max(1, n)) + 1)
    rows = labelled.where(share).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).persist()
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = counts.select("lang", "n", padded.alias("p"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size")).where(F.length("p") >= F.col("size"))
    grams = grams.select("lang", "size", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - F.col("size") + 1), lambda i: F.substring("p", i, F.col("size")))).alias("entry"))
    grams = grams.where("entry <> ' '").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    every = counts.select("lang", F.lit(0).alias("size"), F.concat(F.lit("="), F.col("word")).alias("entry"), "n").unionByName(grams)
    width = max(1, len(languages))
    most = max(1, min(max_entries, MAX_CELLS // width) // (width * (LONGEST + 1)))
    # the most frequent of each part first, so that the commonest language is no task's alone
    totals = every.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("lang", "size", *keys).orderBy(F.desc("n"), "entry"))
    kept = every.where((F.col("n") >= 2) | (F.col("size") > 0)).withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(PARTS)))
    kept = kept.withColumn("rank", rank("part")).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", rank()).where(F.col("rank") <= most)
    kept = kept.join(F.broadcast(totals), ["lang", "size"])  # six rows for each of at most MAX_LANGUAGES
    found = kept.select("lang", "size", "entry", "n", "total", "kinds").toPandas()
    counts.unpersist()
    return _model(languages, found)


def _model(languages: list[str], found: pd.DataFrame) -> Model:
    names = sorted(set(found["entry"]))
    entries = {e: i for i, e in enumerate(names)}
    size = np.zeros(len(names), np.int64)
    at = found["entry"].map(entries).to_numpy(np.int64)
    size[at] = found["size"].to_numpy(np.int64)
    counts = np.zeros((len(names), len(languages)))
    column = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    counts[at, column] = found["n"]
    total, kinds = np.ones((LONGEST + 1, len(languages))), np.ones((LONGEST + 1, len(languages)))
    total[found["size"].to_numpy(np.int64), column] = found["total"]
    kinds[found["size"].to_numpy(np.int64), column] = found["kinds"]
    scores = np.log((counts + 0.5) / (total + 0.5 * kinds)[size])
    return Model(languages, entries, scores.astype(np.float32))


class _Cache:
    """The scores of words that were met, as rows of one table; NaN for what isn't a word."""

    def __init__(self, model: Model):
        self.model, self.width = model, max(1, len(model.languages))
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((min(_CACHE_WORDS, _CACHE_BYTES // (4 * self.width)) + 1, self.width), np.float32)

    def look_up(self, words: Sequence[str]) -> np.ndarray:
        out = np.empty((len(words), self.width), np.float32)
        at = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        known = at >= 0
        out[known] = self.scores[at[known]]
        if len(self.rows) + int((~known).sum()) > len(self.scores):
            self.rows.clear()
        for i in np.flatnonzero(~known).tolist():
            word = words[i]
            # numerals such as the Roman ones count as word characters but aren't letters
            out[i] = self.model.word(word) if self.model.languages and any(map(str.isalpha, word)) else np.nan
            if len(self.rows) < len(self.scores):
                self.scores[len(self.rows)] = out[i]
                self.rows[word] = len(self.rows)
        return out


def _predict(model: Model, texts: list[str | None], cache: _Cache) -> tuple[list[str], np.ndarray]:
    found = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(x) for x in found])
    n, width = len(texts), max(1, len(model.languages))
    doc = np.repeat(np.arange(n), sizes)
    codes, unique = pd.factorize(np.array([w for x in found for w in x], dtype=object))
    table = cache.look_up(unique)
    letters = ~np.isnan(table[:, 0])
    table = np.nan_to_num(table)
    sums = np.stack([np.bincount(doc, table[codes, k], n) for k in range(width)], axis=1)
    words = np.bincount(doc, letters[codes], n)
    scaled = sums / np.maximum(1, words)[:, None] * np.minimum(words, SCORE_WORDS)[:, None]
    odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    best = sums.argmax(axis=1)
    score = (odds / odds.sum(axis=1, keepdims=True))[np.arange(n), best]
    known = (words > 0) & bool(model.languages)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 0.0)


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row for each row of docs(doc_id, text, ...).

    The columns of docs that keep names follow, unchanged.

    The prediction reads the text alone, all of it. A null or empty text, or one without a letter, is
    `und` with score 0; so is every text when the model learned no language. A letter text of which
    nothing is known, and a tie, get the first language by code point. Extra columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(shared.value)
        for batch in slices(batches):
            names, scores = _predict(shared.value, batch.column(2).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", *keep])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), (bucket(F.col("doc_id")) == 0).alias("held_out"), "text", *(F.col(c).alias(f"keep_{c}") for c in keep))
    return rows.mapInArrow(scan, columns(docs, keep, "doc_id long, held_out boolean, lang_pred string, score double"))


def identify_by_own_labels(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Learn from the documents that aren't held out, then predict them all."""
    return identify(docs, keep=keep, model=train(docs.where(bucket(F.col("doc_id")) != 0).select("doc_id", "text", "lang")))
