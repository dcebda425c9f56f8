"""Helpers that the training-data operators share.

Words are cut on byte classes, straight on Arrow's UTF-8 buffers: every class used here
treats all non-ASCII bytes alike, so bytes and code points give the same words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space, as a pattern for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Words of letters and digits after A-Z became a-z.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that are tokenized at once in a Python worker (a longer document is taken alone).
SLICE_BYTES = 1_000_000


#: Rows that Spark hands to Python at once: its default of 10,000 texts may be a hundred MB on both sides.
BATCH_ROWS = 2_000


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches bounded (a smaller bound of the user's own stays)."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, gets one of its own where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/quillstream/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column | str = "text") -> Column:
    """With doc_id, what tells the rows of a table apart: rows that have both in common are alike in all an operator reads."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.isnull(text))


def columns(df: DataFrame, names: Sequence[str], own: str) -> str:
    """own, a schema in DDL, with more columns of df behind; these may not have the names of its own columns."""
    taken = {c.split()[0] for c in own.split(", ")} & set(names)
    if taken:
        raise ValueError(f"columns to keep have names of the result's: {sorted(taken)}")
    return own + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column, pattern: str = WORD) -> Column:
    """array<string> of the words of a text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


# ---- byte-level tokenizing in Python workers ----


def _space_class() -> np.ndarray:
    keep = np.ones(256, bool)
    keep[0x20] = False
    keep[0x09:0x0E] = False
    return keep


def _alnum_class() -> np.ndarray:
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = True
    keep[0x41:0x5B] = True  # folded to lower case before hashing
    keep[0x61:0x7B] = True
    keep[0x80:] = True
    return keep


SPACE_WORDS, ALNUM_WORDS = _space_class(), _alnum_class()
_SEED = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _SEED.copy()
_FOLDED[0x41:0x5B] = _SEED[0x61:0x7B]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(max(n + 1, SLICE_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (SplitMix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Words of a slice of documents.

    buf: the bytes; start, end: byte range of each word; first: for document i its words are
    first[i] to first[i + 1].
    """

    def __init__(self, texts: pa.Array, classes: np.ndarray = SPACE_WORDS, fold: bool = False):
        self.buf, offsets = utf8(texts)
        self.offsets = offsets
        inside = classes[self.buf]
        n = len(inside)
        starts, ends = inside.copy(), inside.copy()
        if n:
            before, after = inside[:-1].copy(), inside[1:].copy()
            cut = offsets[(offsets > 0) & (offsets < n)]
            before[cut - 1] = False
            after[cut - 1] = False
            starts[1:] &= ~before
            ends[:-1] &= ~after
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.fold = fold

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.buf))
        total = np.empty(len(self.buf) + 1, np.uint64)
        total[0] = 0
        np.cumsum((_FOLDED if self.fold else _SEED)[self.buf] * up[: len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def document(self) -> np.ndarray:
        """The index of each word's document in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (with the end last); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or not len(offsets) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def window_hash(word_hash: np.ndarray, n: int, base: int = 0xD1B54A32D192ED03) -> np.ndarray:
    """For each start, a 64-bit hash of n words in a row (len - n + 1 of them); documents aren't told apart."""
    out, done = None, 0
    part, span, power = word_hash, 1, np.full(1, base | 1, np.uint64)  # arrays wrap around silently; part[i]: the hash of span words from i; power: q ** span
    rest = n
    while rest:
        if rest & 1:
            size = len(word_hash) - (done + span) + 1
            if size <= 0:
                return np.zeros(0, np.uint64)
            out = part[:size].copy() if out is None else out[:size] * power + part[done : done + size]
            done += span
        rest >>= 1
        if rest:
            size = len(part) - span
            if size <= 0:
                return np.zeros(0, np.uint64)
            part = part[:size] * power + part[span : span + size]
            power, span = power * power, span * 2
    return mix(out)


def within(tokens: Tokens, n: int) -> np.ndarray:
    """Starts of the n-word windows that lie inside one document."""
    if len(tokens) < n:
        return np.zeros(0, np.int64)
    doc = tokens.document()
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about size bytes of text, or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
