"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of 16 or more key characters with a digit in it. The network reads the candidate, in
overlapping windows if it is long, and the text around it. It learns from labelled findings: what the patterns
found and plain candidates, in all documents, and made keys and hard negatives. Findings are dealt into groups; in
each epoch every group trains on from the same weights, whose mean the next begins with. The network is
calibrated on held-out findings of all groups, and accepts candidates at the highest threshold that still keeps the recall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, slices, small_batches, stash
from .secret_examples import examples

# fixed values: the patterns of the base rules
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "net")

CANDIDATE_CHARS = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: Findings of the documents in a group, and made examples, of both labels together, that each group trains on beside its own.
GROUP, MADE = 8_000, 12_000
RECALL, EPOCHS = 0.99, 6
#: Logits are counted in steps of 1 / STEPS, rounded down, to calibrate.
STEPS = 1_024
LEFT, BODY, RIGHT = 24, 48, 16


def _class(chars: str) -> np.ndarray:
    keep = np.zeros(256, bool)
    keep[np.frombuffer(chars.encode(), np.uint8)] = True
    return keep


_KEY_BYTES = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_HEX_BYTES = _class("0123456789abcdef")
_DIGIT = re.compile(r"[0-9]")
_RUNS, _NAME = re.compile(r"[A-Za-z0-9]+"), re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)[0-9]{0,4}|[0-9]+[a-z]{0,3}")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' findings, in code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Where the network is asked."""
    return [m.span() for m in CANDIDATE.finditer(text) if _DIGIT.search(m[0])]


def view(text: str, start: int, end: int) -> str:
    """What the network reads of a candidate, always LEFT + BODY + RIGHT characters; NUL pads."""
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + text[start : min(end, start + BODY)].ljust(BODY, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """What the network reads of a candidate in turn: overlapping stretches of BODY characters, up to its end."""
    if end - start <= BODY:
        return [(start, end)]
    return [(i, i + BODY) for i in [*range(start, end - BODY, BODY // 2), end - BODY]]


def encode(views: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(views).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(views), -1)
    return np.minimum(codes, 128).astype(np.int64)


@dataclass
class Network:
    """Embedding, one convolution, pooling of the left, the candidate and the right, and a logistic output."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0  # calibration: probability = sigmoid(scale * logit + shift)
    shift: float = 0.0
    threshold: float = 2.0
    trained: int = 0  # findings of the documents that it learned from in each epoch, and those that it was calibrated on
    held: int = 0

    WIDTH, DEPTH, FILTERS = 5, 8, 24

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        d, f = cls.DEPTH, cls.FILTERS
        shapes = {"embed": (129, d), "conv": (cls.WIDTH * d, f), "bias": (f,), "out": (4 * f,), "zero": (1,)}
        return cls({k: rng.normal(0, 0.5 if k == "embed" else (2 / s[0]) ** 0.5 if len(s) > 1 else 0.1 if k == "out" else 0, s) for k, s in shapes.items()})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, k = self.weights, self.WIDTH
        e = w["embed"][x]
        cols = np.concatenate([e[:, i : e.shape[1] - k + 1 + i] for i in range(k)], axis=2)
        h = np.maximum(cols @ w["conv"] + w["bias"], 0)
        parts = (slice(0, LEFT), slice(LEFT, LEFT + BODY - k + 1), slice(LEFT + BODY - k + 1, h.shape[1]))
        tops = [h[:, p].argmax(axis=1) for p in parts]
        pooled = [np.take_along_axis(h[:, p], t[:, None], axis=1)[:, 0] for p, t in zip(parts, tops)]
        pooled = np.concatenate([*pooled, h[:, parts[1]].mean(axis=1)], axis=1)
        return pooled @ w["out"] + w["zero"][0], (cols, h, parts, tops, pooled)

    def gradients(self, x: np.ndarray, error: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        w, k, f = self.weights, self.WIDTH, self.FILTERS
        cols, h, parts, tops, pooled = kept
        d_pooled = error[:, None] * w["out"]
        d_h = np.zeros_like(h)
        for i, (p, t) in enumerate(zip(parts, tops)):
            np.put_along_axis(d_h[:, p], t[:, None], d_pooled[:, None, i * f : (i + 1) * f], axis=1)
        d_h[:, parts[1]] += d_pooled[:, None, 3 * f :] / (parts[1].stop - parts[1].start)
        d_h *= h > 0
        d_cols = d_h @ w["conv"].T
        d_e = np.zeros((*x.shape, self.DEPTH))
        for i in range(k):
            d_e[:, i : i + h.shape[1]] += d_cols[:, :, i * self.DEPTH : (i + 1) * self.DEPTH]
        d_embed = np.bincount((x[:, :, None] * self.DEPTH + np.arange(self.DEPTH)).ravel(), d_e.ravel(), w["embed"].size).reshape(w["embed"].shape)
        return {"embed": d_embed, "conv": np.tensordot(cols, d_h, ((0, 1), (0, 1))), "bias": d_h.sum(axis=(0, 1)), "out": pooled.T @ error, "zero": error.sum(keepdims=True)}

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * _logits(self, x) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


Moments = tuple[dict[str, np.ndarray], dict[str, np.ndarray]]


def _no_moments(net: Network) -> Moments:
    return {k: np.zeros_like(v) for k, v in net.weights.items()}, {k: np.zeros_like(v) for k, v in net.weights.items()}


def _epoch(net: Network, moments: Moments, step: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> int:
    """Train on each row of x once, by Adam; the number of the last step."""
    first, second = moments
    order = rng.permutation(len(y))
    for i in range(0, len(order), 128):
        rows = order[i : i + 128]
        seen = x[rows].astype(np.int64)
        blind = rng.random(len(rows)) < 0.3  # now and then without its surroundings: the candidate alone must do
        seen[blind, :LEFT] = 0
        seen[blind, LEFT + BODY :] = 0
        logits, kept = net.forward(seen)
        grads = net.gradients(seen, (_sigmoid(logits) - y[rows]) * weight[rows] / len(rows), kept)
        step += 1
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return step


def _calibrate(net: Network, logits: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
    """Platt scaling, and the threshold, on held-out findings: n of each logit and label."""
    mean = np.average(logits, weights=n)
    variance = np.average((logits - mean) ** 2, weights=n)
    for _ in range(200):
        gap = _sigmoid(net.scale * logits + net.shift) - y
        net.scale -= 0.1 * float(np.average(gap * logits, weights=n) / (1 + variance))
        net.shift -= 0.1 * float(np.average(gap, weights=n))
    positive, n = _sigmoid(net.scale * logits + net.shift)[y == 1], n[y == 1]
    order = np.argsort(positive)
    passed = np.cumsum(n[order])
    net.threshold = float(positive[order][np.searchsorted(passed, np.floor((1 - recall) * passed[-1]), side="right")])


def _split(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which rows are held out: a fifth of either label."""
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == label))
        held[rows[: len(rows) // 5]] = True
    return held


def _logits(net: Network, x: np.ndarray) -> np.ndarray:
    return np.concatenate([net.forward(x[i : i + 512].astype(np.int64))[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)


def fit(views: list[str], labels: list[bool], recall: float = RECALL, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Train on four fifths of the findings; calibrate and set the threshold on the rest.

    Without ten findings of either label there is nothing to learn from: the threshold stays out of reach.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    x, y = encode(views) if views else np.zeros((0, LEFT + BODY + RIGHT), np.int64), np.array(labels, float)
    if min(y.sum(), (1 - y).sum()) < 10:
        return net
    held = _split(y, rng)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))  # both labels count alike
    moments, step = _no_moments(net), 0
    for _ in range(epochs):
        step = _epoch(net, moments, step, x[~held], y[~held], weight[~held], rng)
    _calibrate(net, _logits(net, x[held]), y[held], np.ones(held.sum()), recall)
    return net


def _flagged(batch_text: pa.Array) -> np.ndarray:
    """Documents with a long run of key characters or of hex digits, a ':' or a '='; all others have no finding."""
    keys = Tokens(batch_text, _KEY_BYTES)
    out = np.zeros(len(keys.first) - 1, bool)
    mark = lambda places: np.logical_or.at(out, np.searchsorted(keys.offsets, places, side="right") - 1, True)
    mark(keys.start[keys.end - keys.start >= CANDIDATE_CHARS])
    mark(np.flatnonzero((keys.buf == ord(":")) | (keys.buf == ord("="))))
    return out  # 20 access or 24 hex characters in a row are a long run of key characters too


def is_plain(candidate: str) -> bool:
    """Whether a candidate is made of words and numbers alone, as names, dates, hosts and paths are: then it is labelled no secret."""
    return all(_NAME.fullmatch(x) for x in _RUNS.findall(candidate))


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labelled candidates: what a pattern finds, and plain ones. Of others nothing is known."""
    for batch in slices(batches):
        ids, places, views, labels = [], [], [], []
        for i in np.flatnonzero(_flagged(batch.column(1))):
            text = batch.column(1)[i].as_py()
            base = base_spans(text)
            for start, end in candidates(text):
                found = any(s < end and start < e for s, _, e in base)
                if found or is_plain(text[start:end]):
                    for w in windows(start, end):
                        ids.append(batch.column(0)[i].as_py()), places.append(w[0]), views.append(view(text, *w)), labels.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(views, pa.string()), pa.array(labels, pa.bool_())], names=["doc_id", "place", "view", "label"])


def train(docs: DataFrame, group: int = GROUP, made: int = MADE, recall: float = RECALL, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network from labelled findings: all of docs(doc_id, text), and made ones.

    In docs the patterns' findings are labelled secret and plain candidates not. They are dealt by a hash into groups of about `group`;
    a task trains on one group, and on `made` examples of keys that no pattern knows and of hard negatives. A fifth of either label
    is held out of training, and calibrates. Only weights and counts pass the driver. Documents without a candidate, or none at all, leave the made ones.
    """
    spark = docs.sparkSession
    rows = small_batches(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), "text").mapInArrow(_findings, "doc_id long, place long, view string, label boolean")
    rows = stash(rows, "findings")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    groups = max(1, -(-sum(counts.values()) // group))
    views, labels = [], []
    for text, start, end, label in examples(made):
        for w in windows(start, end):
            views.append(view(text, *w)), labels.append(label)
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    # of all groups together, each with the made examples
    total = [counts.get(label, 0) + groups * labels.count(label) for label in (False, True)]
    if min(total) < 10:
        return net
    y = np.array(labels, float)
    shared = spark.sparkContext.broadcast((encode(views).astype(np.uint8) if views else np.zeros((0, LEFT + BODY + RIGHT), np.uint8), y, _split(y, rng)))
    place = F.xxhash64("view", "doc_id", "place")
    # a row without a view for each group, as one may be empty
    dealt = rows.select(F.pmod(place, F.lit(groups)).alias("group"), place.alias("hash"), "view", "label")
    dealt = dealt.unionByName(spark.range(groups).select(F.col("id").alias("group")), allowMissingColumns=True).repartition(groups, "group").groupBy("group")

    def read(found: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        number = found.column("group")[0].as_py()
        found = found.filter(pc.is_valid(found.column("view"))).sort_by([("hash", "ascending"), ("view", "ascending"), ("label", "ascending")])
        views, own = found.column("view").to_pylist(), np.array(found.column("label").to_pylist(), float)
        x = encode(views).astype(np.uint8) if views else np.zeros((0, LEFT + BODY + RIGHT), np.uint8)
        return number, x, own, _split(own, np.random.default_rng((seed, number)))

    def tried(net: Network, moments: Moments, step: int, epoch: int):
        def run(found: pa.Table) -> pa.Table:
            number, x, own, held = read(found)
            more_x, more, more_held = shared.value
            x, labels = np.concatenate([x[~held], more_x[~more_held]]), np.concatenate([own[~held], more[~more_held]])
            weight = np.where(labels == 1, sum(total) / (2 * total[1]), sum(total) / (2 * total[0]))  # both labels count alike
            after = Network(dict(net.weights))
            state = tuple(dict(m) for m in moments)
            last = _epoch(after, state, step, x, labels, weight, np.random.default_rng((seed, number, epoch)))
            flat = np.concatenate([v.ravel() for part in (after.weights, *state) for v in part.values()])
            return pa.table({"group": [number], "n": [int((~held).sum())], "step": [last], "values": pa.array([flat], pa.list_(pa.float64()))})

        return run

    moments, step = _no_moments(net), 0
    for epoch in range(epochs):
        found = sorted(dealt.applyInArrow(tried(net, moments, step, epoch), "group long, n long, step long, values array<double>").collect())
        flat, at = np.mean([r["values"] for r in found], axis=0), 0
        for part in (net.weights, *moments):
            for k, v in part.items():
                part[k], at = flat[at : at + v.size].reshape(v.shape), at + v.size
        step, net.trained = max(r["step"] for r in found), sum(r["n"] for r in found)

    def count(found: pa.Table) -> pa.Table:
        _, x, own, held = read(found)
        return _counted(net, x[held], own[held], 1)

    own = dealt.applyInArrow(count, "label double, logit long, n long").groupBy("label", "logit").agg(F.sum("n").alias("n")).orderBy("label", "logit").toArrow()
    net.held = sum(own.column("n").to_pylist())
    more_x, more, more_held = shared.value
    label, logit, n = (np.concatenate([a.to_numpy(), b.to_numpy()]) for a, b in zip(own.columns, _counted(net, more_x[more_held], more[more_held], groups).columns))
    _calibrate(net, logit / STEPS, label, n.astype(float), recall)
    return net


def _counted(net: Network, x: np.ndarray, y: np.ndarray, times: int) -> pa.Table:
    """(label, logit, n) of the rows of x, with logits in steps; each row counts so many times."""
    found, n = np.unique(np.stack([y, np.floor(np.clip(_logits(net, x), -40, 40) * STEPS)]), axis=1, return_counts=True)
    return pa.table({"label": found[0], "logit": found[1].astype(np.int64), "n": n.astype(np.int64) * times})


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, spans) of docs(doc_id, text): one row for each input row.

    spans: array<struct<start, kind, end, probability>> by start, then kind (assign, access, hex, net), in code
    points, end exclusive; probability is null for the patterns' findings. Those always stay; the network
    adds candidates that overlap none of them. A null or empty text has no spans; repeated rows each get
    theirs; other columns aren't read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        kind = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("probability", pa.float64())])
        for batch in slices(batches):
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            asked, parts, views = [], [], []  # parts: where each candidate's views begin
            for i in np.flatnonzero(_flagged(batch.column(1))):
                text = batch.column(1)[i].as_py()
                base = base_spans(text)
                spans[i] = [(s, KINDS.index(k), e, None) for s, k, e in base]
                for start, end in candidates(text):
                    if not any(s < end and start < e for s, _, e in base):
                        asked.append((i, start, end)), parts.append(len(views))
                        views += [view(text, *w) for w in windows(start, end)]
            for (i, start, end), p in zip(asked, np.maximum.reduceat(net.probability(encode(views)), parts) if views else ()):
                if p >= net.threshold:
                    spans[i].append((start, len(KINDS) - 1, end, float(p)))
            rows = [[{"start": s, "kind": KINDS[k], "end": e, "probability": p} for s, k, e, p in sorted(x, key=lambda r: r[:3])] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:string,end:long,probability:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the patterns' findings, their hash, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:-1]), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans")
    )
