import random

import numpy as np
import pytest

from quillstream.llm import graph, neardup
from .conftest import prose


def shingles(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return words


@pytest.mark.parametrize("shingle", [2, 5])
def test_matches_brute_force(documents, shingle):
    rng = random.Random(shingle)
    rows = []
    for g in range(25):
        base = prose(rng, rng.choice([3, 20, 100, 300])).split()
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((len(rows), " ".join(near(rng, base, rng.randrange(1 + len(base) // 15)))))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), shingle).collect()}
    assert found == brute(rows, shingle, 80)


@pytest.mark.parametrize("changes", [8, 30])
def test_large_groups_are_cut_into_blocks(documents, monkeypatch, changes):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(3)
    base = prose(rng, 150).split()
    rows = [(i, " ".join(near(rng, base, rng.randrange(changes)))) for i in range(80)] + [(100 + i, " ".join(base)) for i in range(30)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), 2).collect()}
    assert found == brute(rows, 2, 80)


def test_rows_of_one_id_are_one_document(documents):
    rng = random.Random(6)
    a, b, c = (prose(rng, 60).split() for _ in range(3))
    one = lambda w: " ".join(near(rng, w, 1))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, one(b)), (3, one(a)), (5, " ".join(c)), (7, one(c)), (9, one(c)), (9, one(a)), (20, "alone"), (20, "alone"), (None, " ".join(a))]
    out = neardup.near_duplicates(documents(rows), 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id) == sorted((i, 20 if i == 20 else 1, i in (1, 20)) for i, _ in rows if i)


def test_recall_where_pairs_are_just_similar_enough():
    """Against all pairs: of those at 0.80 to 0.85 none is missed here, as the stated rate has it."""
    rng = np.random.default_rng(2)
    distances = []
    for _ in range(2000):
        n = int(rng.integers(50, 400))
        own = int(n * rng.uniform(0.15, 0.2) / 2 / 0.9)
        both, *apart = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (n - own, own, own))
        sets = [np.unique(np.concatenate([both, x])) for x in apart]
        similarity = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        if 0.8 <= similarity < 0.85:
            s = neardup.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            distances.append((s[0] != s[1]).sum())
    assert len(distances) > 200 and np.mean(np.array(distances) <= neardup.DISTANCE) > 0.999
    assert 1 / neardup.miss_rate(0.8) == pytest.approx(46_100, rel=0.01) and 1 / neardup.miss_rate(0.85) == pytest.approx(4_699_000, rel=0.01)


def test_stars_are_the_components():
    pairs = [np.array([[5, 3], [3, 9]]), np.array([[1, 2], [9, 2], [7, 7]]).reshape(-1, 2)]
    (found,) = neardup._stars(iter(pairs))
    assert sorted(zip(found["a"].to_pylist(), found["b"].to_pylist())) == [(1, 2), (1, 3), (1, 5), (1, 9)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, x])) for x in own]
    s = neardup.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    assert (s[0] != s[1]).sum() <= neardup.DISTANCE  # a similarity of 0.8


def test_the_index_meets_whenever_a_chunk_has_one_error():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    a = rng.integers(0, 65536, (1, neardup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for place in range(0, neardup.SYMBOLS, neardup.PER_CHUNK):  # two errors in every chunk but the last, which has one
        b[0, place] ^= 1
        b[0, place + 1] ^= 1 if place < neardup.SYMBOLS - neardup.PER_CHUNK else 0
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["leader", "signature"])
    (keys,) = neardup._index([batch])
    keys = keys["group"].to_numpy().reshape(2, -1)
    assert len(set(keys[0]) & set(keys[1])) == 1 and (a != b).sum() == neardup.GUARANTEED


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 120)) and found[200] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows_and_no_rows(documents, awkward):
    rows = [r for r in awkward if r[0] is not None]
    out = neardup.near_duplicates(documents(rows), 2).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by[1].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[8].component_id == 7 and not by[8].kept and by[10].component_id == 9 and by[5].n_shingles == 1
    assert neardup.near_duplicates(documents([])).count() == 0
    out = neardup.near_duplicates(documents([*awkward, (None, "same text here", "en", "a")])).collect()
    assert len(out) == len(awkward) + 1 and all(r.kept and r.component_id is None for r in out if r.doc_id is None)
