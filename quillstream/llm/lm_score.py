"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

Every word is predicted from the two words on either side of it. The network gives each word of the vocabulary a score f
in its surroundings, and log P(word | both sides) = log q(word) + f - log Z: q is the word's share of the corpus, from the
counts of all its words, and Z the mean of exp f over words drawn from q, at fixed quantiles. Words beyond the vocabulary
share their scores f within buckets, but each has its own q, joined from the table of all counts. A document's score is the
sum over its words.

Training is data-parallel by a sampled softmax: documents are dealt by a hash of their own into shards whose number
depends on the corpus alone, every shard starts a round from the same weights and takes its documents in the order of
doc_id, and each vector is averaged over the shards by how often they met it. So the number of tasks changes no score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Tokens, mix, signed, slices, small_batches, stash

#: Words with vectors of their own, the most frequent ones; bounds what is broadcast. Buckets of all others. Both together fit in two bytes.
VOCABULARY, BUCKETS = 40_000, 1_024
#: Words whose counts are broadcast, too, twelve bytes each; those of rarer words are joined.
COUNTED = 1_000_000
SIDE, DEPTH, HIDDEN = 2, 16, 32
#: Words drawn for each step of training, and quantiles for Z.
NOISE, QUANTILES = 64, 128
ROUNDS, TRAIN_SHARE, BATCH, RATE = 2, 1.0, 1024, 0.05
#: Words of a shard; a corpus of more than MAX_SHARDS such has larger ones.
SHARD_WORDS, MAX_SHARDS = 5_000_000, 4_096
#: Vectors that are averaged together.
PIECE = 1_024
#: The count of a word that the corpus doesn't have.
UNSEEN = 0.5


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted word hashes, of the vocabulary and of other words whose counts are at hand
    leaves: np.ndarray  # the leaf of each
    log_q: np.ndarray  # the log share of each
    size: int  # words of the vocabulary
    share: np.ndarray  # of each leaf: words, then buckets
    total: int  # words of the corpus
    counts: DataFrame = field(repr=False)  # (word, n) of all words

    def __getstate__(self) -> dict:
        return vars(self) | {"counts": None}  # tasks have no use for the table

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each word, and its log share; NaN for words whose count isn't at hand."""
        others = self.size + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if not len(self.hashes):
            return others, np.full(len(hashes), np.nan)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.leaves[at], others), np.where(known, self.log_q[at], np.nan)

    def quantiles(self, points: np.ndarray) -> np.ndarray:
        """The leaves at points of 0 to 1 of the words' shares."""
        if not self.total:
            return np.zeros(len(points), np.int64)
        return np.minimum(np.searchsorted(np.cumsum(self.share), points, side="right"), len(self.share) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, counts = np.unique(Tokens(batch.column(0), SPACE_WORDS, fold=True).hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(counts, pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, size: int = VOCABULARY, counted: int = COUNTED) -> Vocabulary:
    """From the counts of all words of all documents; only the most frequent come to the driver, and the buckets' sums."""
    counts = stash(docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(max(size, counted)).toArrow()
    # unsigned remainders of the hashes, as in look_up
    bucket = F.pmod("word", F.lit(BUCKETS)).cast("int")
    sums = dict(map(tuple, counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()))
    n, hashes = top["n"].to_numpy(), top["word"].to_numpy().view(np.uint64)
    size = min(size, len(n))
    every = np.array([sums.get(b, 0) for b in range(BUCKETS)], np.int64)
    own = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    rest = every - np.bincount(own[:size], n[:size], BUCKETS).astype(np.int64)
    total = int(every.sum())
    order = np.argsort(hashes)
    leaves = np.where(np.arange(len(n)) < size, np.arange(len(n)), size + own)
    return Vocabulary(hashes[order], leaves[order].astype(np.uint16), np.log(n / max(1, total))[order].astype(np.float32), size, np.concatenate([n[:size], rest]) / max(1, total), total, counts)


Weights = dict[str, np.ndarray]


def fresh(leaves: int, seed: int = 8) -> Weights:
    """embed: a vector for every leaf, and the last for what is beyond a document's ends; out: likewise, with a bias behind."""
    rng = np.random.default_rng(seed)
    w = {
        "embed": rng.normal(0, 0.3, (leaves + 1, DEPTH)), "hidden": rng.normal(0, (2 * SIDE * DEPTH) ** -0.5, (2 * SIDE * DEPTH, HIDDEN)),
        "bias": np.zeros((1, HIDDEN)), "out": np.zeros((leaves, HIDDEN + 1)),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def contexts(leaves: np.ndarray, first: np.ndarray, beyond: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """For each word, or those at some places, the leaves of the SIDE words before it and after it; `beyond` outside the document."""
    # all documents in a row, with SIDE times `beyond` around each
    place = np.arange(len(leaves)) + SIDE * np.repeat(np.arange(1, len(first)), np.diff(first))
    padded = np.full(len(leaves) + SIDE * len(first), beyond, np.int64)
    padded[place] = leaves
    steps = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
    return padded[place[at][:, None] + steps]


def _hidden(w: Weights, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = w["embed"].take(around, axis=0).reshape(len(around), -1)
    h = np.ones((len(around), HIDDEN + 1), x.dtype)  # the last multiplies the bias of out
    np.maximum(x @ w["hidden"] + w["bias"], 0, out=h[:, :-1])
    return x, h


def surprise(w: Weights, around: np.ndarray, target: np.ndarray, quantiles: np.ndarray, rows: int = 8192) -> np.ndarray:
    """f - log Z of each target in its surroundings."""
    out = np.empty(len(target), np.float64)
    drawn = w["out"][quantiles].T
    for i in range(0, len(target), rows):
        _, h = _hidden(w, around[i : i + rows])
        z = h @ drawn
        top = z.max(axis=1)
        z -= top[:, None]
        np.exp(z, out=z)
        out[i : i + rows] = np.einsum("ij,ij->i", h, w["out"].take(target[i : i + rows], axis=0)) - top - np.log(z.mean(axis=1))
    return out


def _sums(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, the sums of their rows, and how many rows each has."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # two bytes sort by their digits
    ids = ids[order]
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[head], np.add.reduceat(rows.take(order, axis=0), head), np.diff(np.append(head, len(ids)))


def train_step(w: Weights, seen: Weights, met: Weights, around: np.ndarray, target: np.ndarray, noise: np.ndarray) -> None:
    """One step of Adagrad, in place, on the cross entropy of each target against the drawn words; met counts how often each vector is used."""
    x, h = _hidden(w, around)
    own, drawn = w["out"].take(target, axis=0), w["out"].take(noise, axis=0)
    z = np.concatenate([np.einsum("ij,ij->i", h, own)[:, None], h @ drawn.T], axis=1)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[:, 0] -= 1
    z /= len(target)
    d_h = (z[:, :1] * own + z[:, 1:] @ drawn)[:, :-1] * (h[:, :-1] > 0)
    d_x = (d_h @ w["hidden"].T).reshape(-1, DEPTH)
    d_out = _sums(np.concatenate([target, noise]), np.concatenate([z[:, :1] * h, z[:, 1:].T @ h]))
    whole = slice(None)
    for k, (ids, g, n) in (("embed", _sums(around.reshape(-1), d_x)), ("hidden", (whole, x.T @ d_h, len(target))), ("bias", (whole, d_h.sum(axis=0)[None], len(target))), ("out", d_out)):
        squares = g * g
        squares += seen[k][ids]
        seen[k][ids] = squares
        np.sqrt(squares, out=squares)
        squares += 1e-6
        g *= RATE
        g /= squares
        w[k][ids] -= g
        met[k][ids] += n


def numbered(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, doc_id, n_tokens, log_q, leaves, others): each document's leaves in two bytes each, the sum of its vocabulary words' log shares, and its other words' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = Tokens(batch.column(1), SPACE_WORDS, fold=True)
            hashes = tokens.hashes()
            leaves, log_q = shared.value.look_up(hashes)
            other = np.isnan(log_q)
            sums = np.bincount(tokens.document(), np.where(other, 0, log_q), batch.num_rows)  # a document's sum doesn't depend on its neighbours
            offsets = np.concatenate([[0], np.cumsum(other)])[tokens.first]
            packed = leaves.astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(tokens.first), pa.int64()), pa.array(sums, pa.float64()),
                    pa.array([packed[a:b].tobytes() for a, b in zip(tokens.first, tokens.first[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(hashes[other]))),
                ],
                names=["doc_id", "n_tokens", "log_q", "leaves", "others"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, log_q double, leaves binary, others array<long>")
    return stash(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _read(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the leaves of all their documents and where each document's begin."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            parts = [np.frombuffer(x, np.uint16) for x in part[column].to_pylist()]
            yield part, np.concatenate([np.zeros(0, np.uint16), *parts]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _train(start, words, share: float, number: int, rounds: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Train on the shards of a partition, one after the other, and yield the vectors that each met, in pieces."""
    schema = pa.schema([("block", pa.string()), ("piece", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), ("vectors", pa.binary())])
    state: list = [None]
    beyond = len(words.value.share)
    cumulated = np.cumsum(words.value.share)

    def begin(shard: int) -> None:
        w = {k: v.copy() for k, v in start.value.items()}
        state[:] = shard, w, {k: np.full_like(v, 1e-3) for k, v in w.items()}, {k: np.zeros(len(v), np.int64) for k, v in w.items()}, np.random.default_rng([shard, number]), [], []

    def step(all_of_it: bool) -> None:
        _, w, seen, met, rng, around, target = state
        if not around:
            return
        a, t = np.concatenate(around), np.concatenate(target)
        full = len(t) if all_of_it else len(t) - len(t) % BATCH
        for i in range(0, full, BATCH):
            noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE), side="right"), beyond - 1)
            train_step(w, seen, met, a[i : i + BATCH], t[i : i + BATCH], noise)
        state[5:] = [a[full:]], [t[full:]]

    def end() -> pa.RecordBatch:
        step(True)
        shard, w, _, met, *_ = state
        rows = []
        for k, v in w.items():
            ids = np.flatnonzero(met[k])
            for piece in np.unique(ids // PIECE).tolist():
                own = ids[ids // PIECE == piece]
                rows.append({"block": k, "piece": piece, "shard": shard, "ids": own.astype(np.int32).tobytes(), "n": met[k][own].astype(np.float32).tobytes(), "vectors": v[own].tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch, leaves, first in _read(batches, "leaves"):
        shards = batch["shard"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        place = np.arange(len(leaves)) - np.repeat(first[:-1], np.diff(first))
        ids = np.repeat(mix(batch["doc_id"].fill_null(0).to_numpy().astype(np.int64).view(np.uint64) + np.uint64(1)), np.diff(first))
        draw = mix(ids + place.astype(np.uint64)) / 2.0**64
        use = np.flatnonzero((draw >= number * share / rounds) & (draw < (number + 1) * share / rounds))
        around, target = contexts(leaves, first, beyond, use), leaves[use]
        for a, b in zip(cuts, [*cuts[1:], len(shards)]):
            if state[0] != shards[a]:
                if state[0] is not None:
                    yield end()
                begin(int(shards[a]))
            own = slice(*np.searchsorted(use, (first[a], first[b])))
            state[5].append(around[own]), state[6].append(target[own])
            step(False)
    if state[0] is not None:
        yield end()


def _average(width: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The means of each piece's vectors; rows come sorted by block, piece and shard, so the sums are always of the same order."""
    now, n, sums = None, None, None

    def done() -> pa.RecordBatch:
        ids = np.flatnonzero(n)
        means = (sums[ids] / n[ids, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([(ids + now[1] * PIECE).astype(np.int32).tobytes()], pa.binary()), pa.array([means.tobytes()], pa.binary())], names=["block", "ids", "vectors"])

    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["block"], row["piece"]):
                if now:
                    yield done()
                now = row["block"], row["piece"]
                n, sums = np.zeros(PIECE), np.zeros((PIECE, width[row["block"]]))
            ids, own = np.frombuffer(row["ids"], np.int32) % PIECE, np.frombuffer(row["n"], np.float32).astype(np.float64)
            n[ids] += own
            sums[ids] += own[:, None] * np.frombuffer(row["vectors"], np.float32).reshape(len(ids), -1)
    if now:
        yield done()


def train(numbers: DataFrame, words: Vocabulary, rounds: int = ROUNDS, share: float = TRAIN_SHARE) -> Weights:
    """Weights after some rounds over all documents; share is the share of all positions, by a hash, that the rounds train on between them, each once."""
    context = numbers.sparkSession.sparkContext
    shared = context.broadcast(words)
    w = fresh(len(words.share))
    width = {k: v.shape[1] for k, v in w.items()}
    count = min(MAX_SHARDS, -(-words.total // SHARD_WORDS)) or 1
    dealt = numbers.where("n_tokens > 0").select(F.pmod(F.xxhash64("doc_id", "leaves"), F.lit(count)).cast("int").alias("shard"), "doc_id", "leaves")
    for number in range(rounds):
        start = context.broadcast(w)
        rows = dealt.repartition(count, "shard").sortWithinPartitions("shard", "doc_id", "leaves")
        parts = rows.mapInArrow(lambda b: _train(start, shared, share, number, rounds, b), "block string, piece int, shard int, ids binary, n binary, vectors binary")  # noqa: B023
        means = parts.repartition("block", "piece").sortWithinPartitions("block", "piece", "shard").mapInArrow(lambda b: _average(width, b), "block string, ids binary, vectors binary")
        w = {k: v.copy() for k, v in w.items()}
        for row in means.toLocalIterator():  # as many vectors as the model has
            w[row["block"]][np.frombuffer(row["ids"], np.int32)] = np.frombuffer(row["vectors"], np.float32).reshape(-1, width[row["block"]])
    return w


def score(numbers: DataFrame, words: Vocabulary, weights: Weights) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood): one row for each row of numbered() documents."""
    context = numbers.sparkSession.sparkContext
    shared, weights = context.broadcast(words), context.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value.quantiles((np.arange(QUANTILES) + 0.5) / QUANTILES)
        for batch, leaves, first in _read(batches, "leaves"):
            around = contexts(leaves, first, len(shared.value.share))
            # one document after the other, so that rounding doesn't depend on its neighbours
            sums = [surprise(weights.value, around[a:b], leaves[a:b], points).sum() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["n_tokens"], pa.array(np.array(sums) + batch["log_q"].to_numpy(), pa.float64())], names=["row", "doc_id", "n_tokens", "inside"])

    found = numbers.select("row", "doc_id", "n_tokens", "log_q", "leaves").mapInArrow(run, "row long, doc_id long, n_tokens long, inside double")
    # words beyond the vocabulary: their counts are joined, each once for a document
    others = numbers.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    log_q = F.log(F.coalesce(F.col("n"), F.lit(UNSEEN)) / max(1, words.total))
    others = others.hint("merge").join(words.counts, "word", "left").groupBy("row").agg(F.sum((F.col("times") * log_q).cast("decimal(30,12)")).cast("double").alias("others"))
    total = F.col("inside") + F.coalesce("others", F.lit(0.0))
    found = found.hint("merge").join(others, "row", "left")
    return found.select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))


def score_by_own_words(docs: DataFrame, rounds: int = ROUNDS, share: float = TRAIN_SHARE) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood): one row for each row of docs(doc_id, text), by a model of docs.

    Words are split at ASCII white space, A-Z lower-cased. Every word of the whole text is predicted. A
    null or wordless text has no tokens, a sum of 0 and a null mean; repeated rows each get their row, as do rows
    without a doc_id; extra columns aren't read; an empty table gives no rows. Scores don't depend on how docs is
    partitioned.
    """
    docs = small_batches(docs).select("doc_id", "text")
    words = vocabulary(docs)
    numbers = numbered(docs, words)
    return score(numbers, words, train(numbers, words, rounds, share))
