"""License scan by ordered signature rules: keywords gate hundreds of patterns, priorities and containment settle overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Tokens, columns, slices, small_batches
from .license_rules import BASE, BASE_WEIGHT, Rule, rules

#: Bytes outside words become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_FINDING = "struct<start: int, end: int, label: string, rule: string, weight: double, base: boolean>"
SCHEMA = f"doc_id long, n_words long, found array<{_FINDING}>"


def folded(text: str) -> bytes:
    """The text's words in lower case, each between single spaces."""
    return b" %s " % re.sub(rb" +", b" ", text.encode().translate(_FOLD)).strip()


@lru_cache(maxsize=1)
def compiled() -> tuple[list[tuple[Rule, re.Pattern, tuple[tuple[int, ...], ...]]], list[bytes]]:
    """The rules (those of the base phrases last) with their patterns and, for each, which keywords it needs; and the keywords."""
    every = rules() + [Rule(f"base {phrase}", label, phrase, tuple((w,) for w in phrase.split()), 9, BASE_WEIGHT) for label, phrase in BASE]
    words = {w: k for k, w in enumerate(dict.fromkeys(w for r in every for group in r.needs for w in group))}
    return [(r, re.compile(f" (?:{r.pattern})(?= )".encode()), tuple(tuple(words[w] for w in group) for group in r.needs)) for r in every], list(words)


@lru_cache(maxsize=4096)
def tried(there: frozenset[int]) -> tuple[tuple[Rule, re.Pattern], ...]:
    """The rules whose needs a text with these keywords meets."""
    return tuple((r, pattern) for r, pattern, needs in compiled()[0] if all(any(k in there for k in group) for group in needs))


@lru_cache(maxsize=1)
def _keyword_hashes() -> tuple[np.ndarray, np.ndarray]:
    hashes = Tokens(pa.array(compiled()[1]), ALNUM_WORDS).hashes()
    order = np.argsort(hashes)
    return hashes[order], order


def keywords_in(tokens: Tokens) -> dict[int, frozenset[int]]:
    """For each document of a slice that holds any: the keywords among its words."""
    table, keyword = _keyword_hashes()
    hashes = tokens.hashes()
    place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    hit = np.flatnonzero(table[place] == hashes)
    pairs = np.unique((np.searchsorted(tokens.first, hit, side="right") - 1) * len(table) + keyword[place[hit]])
    doc, word = np.divmod(pairs, len(table))
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return {int(d[0]): frozenset(w.tolist()) for d, w in zip(np.split(doc, cuts), np.split(word, cuts)) if len(d)}


def survivors(start: np.ndarray, end: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Which findings stay, given in rule order: those that no finding of the same or a better priority contains; of equal ranges the first rule's.

    Containment is transitive, so it doesn't matter whether the container itself stays: one sweep for each priority.
    """
    keep, place = np.ones(len(start), bool), np.arange(len(start))
    for level in np.unique(priority):
        among = np.flatnonzero(priority <= level)
        among = among[np.lexsort((place[among], priority[among], -end[among], start[among]))]
        reach = np.maximum.accumulate(end[among])
        inside = np.concatenate([[False], reach[:-1] >= end[among][1:]])
        mine = priority[among] == level
        keep[among[mine]] = ~inside[mine]
    return keep


def scan_text(words: bytes, there: frozenset[int]) -> list[tuple[int, int, str, str, float, bool]]:
    """The findings in folded words that hold the keywords there, as (start, end, label, rule, weight, base), by start; positions count words from 0."""
    found = [(m.start(), m.end(), rule) for rule, pattern in tried(there) for m in pattern.finditer(words)]
    if not found:
        return []
    space = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)  # the space before word k is the k-th
    start, end = (np.searchsorted(space, np.array([x[k] for x in found])) for k in (0, 1))
    base = np.array([x[2].name.startswith("base ") for x in found])
    keep = base.copy()
    keep[~base] = survivors(start[~base], end[~base], np.array([x[2].priority for x in found])[~base])
    return sorted((s, e, r.label, r.name, r.weight, b) for (_, _, r), s, e, b, k in zip(found, start.tolist(), end.tolist(), base.tolist(), keep) if k)


def _scan(keep: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("rule", pa.string()), ("weight", pa.float64()), ("base", pa.bool_())]))
    names = [f.name for f in kind.value_type]
    for batch in slices(batches):
        tokens = Tokens(batch.column(1), ALNUM_WORDS, fold=True)
        there, found = keywords_in(tokens), [[] for _ in range(batch.num_rows)]
        for i, words in there.items():
            if tried(words):
                found[i] = [dict(zip(names, x)) for x in scan_text(folded(batch.column(1)[i].as_py()), words)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(tokens.first), pa.int64()), pa.array(found, kind), *batch.columns[2:]], names=["doc_id", "n_words", "found", *keep])


def scan(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, found) of docs(doc_id, text, ...), with the columns that keep names behind: one row for each input row.

    found: array of findings by their first word; start and end (exclusive) count words from 0. Words are runs of letters,
    digits and non-ASCII characters, A-Z in lower case. A rule's pattern is tried only where its keywords occur in the
    text. A finding inside another of the same or a better priority goes; of equal ones the earliest rule's stays; the base
    phrases' findings (base) always stay. Null and empty texts have no words and no findings; a doc_id that isn't a whole number becomes null;
    repeated rows each get their row. Nothing is shuffled; texts are read whole, one after the other.
    """
    schema = columns(docs, keep, SCHEMA)
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), "text", *(F.col(c).alias(f"keep_{c}") for c in keep))
    return docs.mapInArrow(lambda batches: _scan(keep, batches), schema)


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and labels for each row of scan(); score: the weight of the surest finding, 0 without one."""
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0)).alias("score"),
        *(c for c in scanned.columns if c not in ("doc_id", "n_words", "found")),
    )
