"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is SYMBOLS minima of its shingle set, each cut to 16 bits. It is split into
CHUNKS; two signatures that differ in at most 2 * CHUNKS - 1 symbols have, by the pigeonhole principle, a
chunk with at most one difference. Every chunk is therefore indexed once for each symbol left out, which
enumerates that one error, and meeting in any index entry makes a candidate.

Within an entry, near signatures are joined to a spanning forest, never to all pairs. The forests of all
entries make families; each link lies within a family, where full sets are compared until its
components are known, again emitting a spanning forest. Large entries and families are cut into blocks of
bounded size, and only what these don't link is compared across them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Tokens, mix, signed, slices, small_batches, stash, text_key, window_hash, within
from .graph import components

CHUNKS, PER_CHUNK = 10, 4
SYMBOLS = CHUNKS * PER_CHUNK
#: Signatures that differ in at most so many symbols are certain to share a chunk but for one error.
GUARANTEED = 2 * CHUNKS - 1
#: The threshold of candidates: all that is guaranteed.
DISTANCE = GUARANTEED
#: Documents and shingles of a block; two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
assert DISTANCE <= GUARANTEED
_SALTS = np.random.default_rng(5).integers(1, 2**63, size=(2, SYMBOLS), dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all documents in a row, and where each document's begin (the end last)."""
    tokens = Tokens(texts, SPACE_WORDS, fold=True)
    words, doc, sizes = tokens.hashes(), tokens.document(), np.diff(tokens.first)
    starts = within(tokens, shingle)
    hashes, owner = window_hash(words, shingle)[starts] if len(starts) else np.zeros(0, np.uint64), doc[starts]
    for few in range(1, shingle):  # fewer words than a shingle: the whole sequence is one
        at = tokens.first[:-1][sizes == few]
        if len(at):
            hashes = np.concatenate([hashes, window_hash(words, few, base=0xA0761D6478BD642F)[at]])
            owner = np.concatenate([owner, np.flatnonzero(sizes == few)])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(sizes) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16[document, SYMBOLS]; zeros for an empty set."""
    out = np.zeros((len(first) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((hashes ^ _SALTS[0, k]) * (_SALTS[1, k] | np.uint64(1)), first[some])
            out[some, k] = mix(least + np.uint64(k)) >> np.uint64(48)
    return out


def _sign(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, first = shingle_sets(batch.column(1), shingle)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(c)), dtype=np.uint64)]) for c in (1, 2)]
        digests = [signed(s[first[1:]] - s[first[:-1]]) for s in sums]  # of the set, in any order
        symbols = signatures(hashes, first)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.diff(first), pa.int64()), pa.array(digests[0]), pa.array(digests[1]), pa.array([s.tobytes() for s in symbols], pa.binary()), pa.array([s.tobytes() for s in symbols.astype(np.uint8)], pa.binary())],
            names=["doc_id", "key", "n_shingles", "set_a", "set_b", "signature", "brief"],
        )


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An entry for every chunk and every symbol left out of it."""
    for batch in batches:
        chunks = _symbols(batch.column(1)).reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64)
        keys = np.empty((batch.num_rows, CHUNKS, PER_CHUNK), np.uint64)
        for out in range(PER_CHUNK):
            packed = np.zeros((batch.num_rows, CHUNKS), np.uint64)
            for i in range(PER_CHUNK):
                if i != out:
                    packed = packed << np.uint64(16) | chunks[:, :, i]
            keys[:, :, out] = mix(mix(packed) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(PER_CHUNK) + np.uint64(out + 1))
        ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(ids)], names=["group", "node"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (group, low, high); rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[c].to_numpy() for c in ("group", "low", "high")]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            here = tuple(k[begin] for k in keys)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of 0..n-1; linked(i, rest) says which of rest are linked with i."""
    rest, out = np.arange(n), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = linked(i, rest)
            new = rest[hit]
            out += [(i, j) for j in new.tolist()]
            todo += new.tolist()
            rest = rest[~hit]
    return out


#: Nodes that a task's union-find holds at most before it is written out.
HELD_NODES = 1_000_000


def _stars(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The components of a task's pairs, each as a star around its least node: in the tasks that see a family it mostly is the same star."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def stars() -> pa.RecordBatch:
        ends = [(root(x), x) for x in list(above)]
        a, b = np.array([e for e in ends if e[0] != e[1]], np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for part in pairs:
        for x, y in part.tolist():
            x, y = sorted((root(x), root(y)))
            above[y] = above[x] = x
        if len(above) > HELD_NODES:
            yield stars()
            above.clear()
    yield stars()


def _similar_sizes(percent: int, n: np.ndarray, i: int, rest: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])


def _near(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of each index entry, a spanning forest of the near signatures."""
    for rows in _groups(batches):
        if rows.num_rows < 2:
            continue
        n, symbols = rows["n_shingles"].to_numpy(), np.frombuffer(b"".join(rows["data"].to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        near = lambda i, rest: _similar_sizes(percent, n, i, rest) & ((symbols[rest] != symbols[i]).sum(axis=1) <= DISTANCE)  # noqa: E731, B023
        yield rows["node"].to_numpy()[np.array(_forest(len(n), near), np.int64).reshape(-1, 2)]


def _link(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of two blocks of a family, a spanning forest of the documents whose full sets are similar."""
    for rows in _groups(batches):
        if rows.num_rows < 2:
            continue
        parts = [np.frombuffer(x, np.uint64) for x in rows["data"].to_pylist()]
        n = np.array([len(x) for x in parts])
        distinct, local = np.unique(np.concatenate(parts), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(len(distinct), np.int32)

        def similar(i: int, rest: np.ndarray) -> np.ndarray:
            out = _similar_sizes(percent, n, i, rest)
            some = rest[out]
            if len(some):
                mark[local[first[i] : first[i + 1]]] = 1
                at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(n[some])[:-1]]), n[some]) + np.arange(n[some].sum())
                common = np.add.reduceat(mark[local[at]], np.concatenate([[0], np.cumsum(n[some])[:-1]]))
                mark[local[first[i] : first[i + 1]]] = 0
                out[out] = 100 * common >= percent * (n[some] + n[i] - common)
            return out

        yield rows["node"].to_numpy()[np.array(_forest(len(n), similar), np.int64).reshape(-1, 2)]


def _sets(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, first = shingle_sets(batch.column(1), shingle)
        sets = pa.array([hashes[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(np.diff(first), pa.int64()), sets, batch.column(3)], names=["group", "node", "n_shingles", "data", "blocks"])


def _families(rows: DataFrame, sizes: DataFrame, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], name: str, more: DataFrame | None = None) -> DataFrame:
    """(id, component) over the links that compare() finds within each group of rows(group, node, n_shingles, data, blocks, seed), and more edges(a, b).

    A group of one block is one run. A larger one is dealt into blocks by a hash, and its seed, one of its nodes, is in every block, so
    that what is like the seed grows together. What is still apart then is compared in full: the members outside a group's largest
    component with all of its members, block by block. So a group of copies takes time in proportion to its size, and only
    what isn't linked costs more. sizes has the column blocks, too, and is quick to read.
    """

    def run(part: DataFrame, what: str) -> DataFrame:
        part = part.select("group", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "node", "n_shingles", "data")
        part = part.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "node")
        return stash(part.mapInArrow(lambda b: _stars(compare(b)), "a long, b long").distinct(), f"{name}-{what}")

    deal = lambda blocks: F.pmod(F.xxhash64("node", "group"), blocks)
    several = F.col("blocks") > 1
    place = F.when(several & (F.col("node") == F.col("seed")), F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).when(several, F.array(deal(F.col("blocks")).cast("int"))).otherwise(F.array(F.lit(0)))
    edges = run(rows.withColumn("low", F.lit(0)).withColumn("high", F.explode(place)), "blocks")
    edges = edges if more is None else edges.union(more)
    labels = components(edges)
    if sizes.where("blocks > 1").isEmpty():
        return labels

    known = labels.select(F.col("id").alias("node"), "component")
    large = stash(rows.where("blocks > 1").hint("merge").join(known, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), f"{name}-large")
    each = large.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = each.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    rest = stash(large.hint("merge").join(largest, "group").where("label <> largest").drop("largest"), f"{name}-rest")
    if rest.isEmpty():
        return labels
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    count = rest.groupBy("group").agg(needed.alias("rest_blocks"))
    meet = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    own, every = rest.hint("merge").join(count, "group"), large.hint("merge").join(count, "group")
    own = own.withColumn("low", deal(F.col("rest_blocks"))).withColumn("high", meet("blocks"))
    every = every.withColumn("high", deal(F.col("blocks"))).withColumn("low", meet("rest_blocks"))
    return components(edges.union(run(own.unionByName(every), "rest")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs(doc_id, text).

    Documents are linked when the Jaccard similarity of their sets of shingle-word shingles (A-Z lower-cased)
    is at least percent / 100. component_id is the smallest doc_id reachable over links; kept says that it
    is the document's own. A null or wordless text has an empty set, is linked with nothing and kept; one
    with fewer words than a shingle has one shingle. Equal sets are linked whatever their number. Rows of
    one doc_id are one document, linked with whatever any of its texts is linked with; each row gives the size of
    its own set, and the smallest doc_id's rows are all kept. A row without a doc_id has no component, is linked
    with nothing and kept. An empty table gives no rows; extra columns aren't read.

    All pairs whose signatures differ in at most DISTANCE of SYMBOLS symbols are certain to be compared: all but one
    in 46,100 of the pairs at a similarity of just 0.8, and one in 4.7 million at 0.85 (see `miss_rate`). Links are confirmed on full sets.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), "text", text_key().alias("key"))
    rows = stash(docs.mapInArrow(lambda b: _sign(shingle, b), "doc_id long, key long, n_shingles long, set_a long, set_b long, signature binary, brief binary"), "signatures")
    worded = rows.where("n_shingles > 0 and doc_id is not null")
    sets = worded.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("leader"), F.min_by("key", "doc_id").alias("key"), F.min_by("signature", "doc_id").alias("signature"), F.min_by("brief", "doc_id").alias("brief")
    )
    # a node for every different set; the number is fixed by the write
    nodes = stash(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    same = ["set_a", "set_b", "n_shingles"]

    # merge joins throughout: what Spark guesses of these tables' sizes is far too low
    entries = nodes.select("node", "signature").mapInArrow(_index, "group long, node long")
    counted = entries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("size"), F.min("node").alias("seed")).where("size > 1")
    counted = stash(counted, "entries")
    crowd = entries.hint("merge").join(counted, "group").hint("merge").join(nodes.select("node", "n_shingles", F.col("brief").alias("data")), "node")
    families = _families(crowd.select("group", "node", "n_shingles", "data", "blocks", "seed"), counted, lambda b: _near(percent, b), "near")

    members = families.withColumnRenamed("id", "node").hint("merge").join(nodes.select("node", "n_shingles", "leader", "key"), "node")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    members = stash(members.join(sizes, "component").select("node", F.col("leader").alias("doc_id"), "key", F.col("component").alias("group"), "blocks"), "families")
    full = docs.hint("merge").join(members, ["doc_id", "key"]).dropDuplicates(["node"]).select("node", "text", "group", "blocks")
    full = full.mapInArrow(lambda b: _sets(shingle, b), "group long, node long, n_shingles long, data binary, blocks long").withColumn("seed", F.col("group"))  # its least node

    # the texts of one doc_id are one document
    of = stash(worded.select("doc_id", *same).distinct().hint("merge").join(nodes.select("node", *same), same).select("doc_id", "node"), "holders")
    own = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    own = of.hint("merge").join(own, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    found = _families(full, members, lambda b: _link(percent, b), "links", own).withColumnRenamed("id", "node")

    ends = nodes.select("node", "leader", *same).hint("merge").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ends.groupBy("component").agg(F.min("leader").alias("component_id"))
    ends = ends.hint("merge").join(least, "component").select(*same, "component_id")
    out = rows.select("doc_id", *same).hint("merge").join(ends, same, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def miss_rate(similarity: float) -> float:
    """The share of pairs of a similarity whose signatures differ in more than DISTANCE symbols: these alone may be missed."""
    return sum(comb(SYMBOLS, k) * (1 - similarity) ** k * similarity ** (SYMBOLS - k) for k in range(DISTANCE + 1, SYMBOLS + 1))
