import random
import re

import numpy as np
import pytest

from quillstream.llm import decontam as d
from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window):
    wanted = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(k) for k in wanted}
    out = {}
    for i, t in rows:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wanted:
                    hit.update(range(p, p + n))
                    got |= wanted[k]
        out[i] = (len(w), len(hit), len(got), d.items_digest(list(got)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def case(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([3, 12, 13, 14, 40]), 25)) for i in range(25)] + [(100, None), (101, ""), (102, "...")]
    rows = []
    for i in range(50):
        w = prose(rng, rng.randrange(0, 90), 25).split()
        for _ in range(rng.randrange(3)):
            part = (rng.choice(items)[1] or "").split()
            w[rng.randrange(len(w) + 1) : 0] = part[: rng.randrange(len(part) + 1)]
        rows.append((i, " ".join(w).upper() if i % 3 else " ".join(w)))
    return rows, items


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, documents, seed):
    rows, items = case(seed)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    blocks = {"block_chars": 500} if seed == 2 else {}
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digest(d.contamination(documents(rows), bench, **blocks)).collect()}
    assert found == brute(rows, items, 13)


@pytest.mark.parametrize("block_chars", [d.BLOCK_CHARS, 300])
def test_rows_of_one_id_each_get_theirs(spark, documents, block_chars):
    rows, items = case(7)
    rows = [(i // 4 if i % 5 else None, t) for i, t in rows + rows[:10]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.digest(d.contamination(documents(rows), bench, block_chars=block_chars)).collect()
    wanted = [(i, *next(iter(brute([(i, t)], items, 13).values()))) for i, t in rows]
    assert sorted(map(str, (tuple(r)[:6] for r in found))) == sorted(map(str, wanted))


def test_fm_index_finds_and_locates_every_occurrence():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 3000)
    text[0] = text[-1] = 0
    keep = np.concatenate([[True], (text[1:] != 0) | (text[:-1] != 0)])
    text = text[keep]
    index = d.FMIndex(text)
    for n in (1, 2, 5):
        patterns = rng.integers(1, 4, (40, n))
        low, high = index.search(patterns[:, ::-1].copy(), np.full(40, n))
        for p, a, b in zip(patterns, low, high):
            places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == places


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 500)
    w = d.WaveletMatrix(x, 6)
    at = np.arange(501)
    for s in (0, 7, 49, 60):
        assert w.rank(np.full(501, s), at.copy()).tolist() == [int((x[:i] == s).sum()) for i in at]
    assert w.access(np.arange(500)).tolist() == x.tolist()


def test_merge():
    assert [x.tolist() for x in d.merge(np.array([5, 1, 2, 9]), np.array([7, 4, 3, 10]))] == [[1, 5, 9], [4, 7, 10]]


def test_awkward_rows_and_empty_tables(spark, documents, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one"), (1, "one"), (2, "same text here"), (None, "nul")], "item_id long, text string")
    assert [r.n_hit for r in d.digest(d.contamination(documents(awkward), none)).collect()] == [0] * len(awkward)
    by = {r.doc_id: r for r in d.digest(d.contamination(documents(awkward), some)).collect()}
    assert by[5].contaminated and by[9].n_hit == 3 and by[1].n_words == 0 and by[7].n_hit == 0 and by[11].n_hit == 1
    assert d.contamination(documents([]), some).count() == 0
    kept = d.contamination(documents(awkward), some, keep=("source",))
    assert kept.columns[-1] == "source" and {r.spans for r in d.digest(d.contamination(documents(awkward).withColumnRenamed("spans", "tally"), some, keep=("tally",))).withColumnRenamed("tally", "spans").collect()} == {"s"}
    with pytest.raises(ValueError):
        d.contamination(documents(awkward), some, keep=("items",))
