import random

import numpy as np
import pytest

from quillstream.llm import substring_dedup as sd
from .conftest import prose


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").split()
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(documents, seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.choice([49, 50, 51, 80, 200]), 30).split() for _ in range(6)]
    rows = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 120), 30).split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            part = rng.choice(shared)
            words[at:at] = part[rng.randrange(3) : len(part) - rng.randrange(3)]
        rows.append((i, " ".join(words)))
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in sd.deduplicate(documents(rows)).collect()}
    assert found == brute(rows, 50)


def test_a_single_repeated_word_and_copies(documents):
    rows = [(1, "de " * 200), (2, "de " * 60), (3, "a b c"), (4, "a b c")]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in sd.deduplicate(documents(rows)).collect()}
    assert found == brute(rows, 50)


def reference(passages, window):
    """passages: (block, doc, words)."""
    first = np.cumsum([0, *(len(w) for _, _, w in passages)])
    words = np.array([x for _, _, w in passages for x in w], np.uint64)
    return sd.Reference(words, first, np.array([b for b, _, _ in passages]), np.array([d for _, d, _ in passages]), window)


@pytest.mark.parametrize("seed", range(20))
def test_factors_are_the_longest_of_earlier_documents(seed):
    rng = random.Random(seed)
    window = rng.choice([2, 5, 8])
    passages = [(rng.randrange(3), rng.randrange(5), [rng.randrange(3) for _ in range(rng.randrange(1, 25))]) for _ in range(12)]
    found = reference(passages, window)
    most = 1 << (window - 1).bit_length()
    at = 0
    for b, d, w in passages:
        earlier = [x for c, e, x in passages if c == b and e < d]
        for i in range(len(w)):
            longest = max((n for n in range(1, len(w) - i + 1) if any(x[j : j + n] == w[i : i + n] for x in earlier for j in range(len(x) - n + 1))), default=0)
            assert found.length[at + i] == min(longest, most)
        at += len(w)
    # the parse covers every word once, and its spans are the windows that an earlier document of the block has
    start, end, _ = found.parse()
    assert sorted(zip(start, end)) == [(s, e) for s, e in zip(sorted(start), sorted(end))] and sum(end - start) == at
    covered = {k for s, e, _ in zip(*found.spans()) for k in range(s, e)}
    wanted, at = set(), 0
    for b, d, w in passages:
        for i in range(len(w) - window + 1):
            if any(x[j : j + window] == w[i : i + window] for c, e, x in passages if c == b and e < d for j in range(len(x) - window + 1)):
                wanted.update(range(at + i, at + i + window))
        at += len(w)
    assert covered == wanted


def test_the_parse_decides(documents, monkeypatch):
    """Two documents share words 20 to 79 in surroundings of their own: no passage is shared whole, the factors find it."""
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(20)), *shared, *(f"b{i}x{k}" for k in range(20))])) for i in (1, 2)]
    found = {r.doc_id: r for r in sd.deduplicate(documents(rows)).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in found.items()} == brute(rows, 50)
    assert min(f.start for f in found[2].factors) == 20 and max(f.end for f in found[2].factors) == 80 and {f.source for f in found[2].factors} == {1}
    far = {r.doc_id: r.n_removed for r in sd.deduplicate(documents(rows), window=61).collect()}
    assert far == {1: 0, 2: 0}


@pytest.mark.parametrize("block_words", [sd.BLOCK_WORDS, 0, 150])
def test_rows_of_one_id_and_large_blocks(documents, block_words):
    rng = random.Random(9)
    pool = [prose(rng, 70, 40) for _ in range(5)]
    rows = [(rng.randrange(12), prose(rng, rng.randrange(20), 40) + " " + " ".join(rng.choice(pool).split()[rng.randrange(9) :]) + " " + prose(rng, rng.randrange(20), 40)) for _ in range(40)]
    rows += [(5, rows[0][1]), (5, rows[1][1]), (5, rows[1][1])]
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, i), i)
    wanted = []
    for i, t in [*rows, (None, rows[3][1])]:
        w = t.split()
        gone = {q for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        wanted.append((str(i), len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    found = sd.deduplicate(documents([*rows, (None, rows[3][1])]), block_words=block_words).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found) == sorted(wanted)
    assert any(x[2] for x in wanted)


def test_sliding_least():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for n in range(1, 8):
        assert sd.sliding_least(x, n).tolist() == [min(x[i : i + n]) for i in range(len(x) - n + 1)]
    assert len(sd.sliding_least(x, 8)) == 0


def test_awkward_rows_and_no_rows(documents, awkward):
    rows = [r for r in awkward if r[0] is not None]
    out = sd.deduplicate(documents(rows)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by[1].n_words == 0 and by[2].kept_text == "" and by[7].n_removed == 0
    assert by[8].kept_text == "tail" and by[10].n_removed == 0
    assert sd.deduplicate(documents([])).count() == 0
    assert sd.deduplicate(documents(awkward)).count() == len(awkward)


def test_factors_of_repeated_rows_grow_in_proportion(documents):
    """A text under one doc_id again and again, and an earlier document that holds half of it: every row has the same factors, whatever their number."""
    rng = random.Random(8)
    text = prose(rng, 400)
    other = " ".join(text.split()[:200]) + " " + prose(rng, 100)

    def factors(n):
        found = sd.deduplicate(documents([(1, other), *[(2, text)] * n, (3, text)])).collect()
        assert {(r.doc_id, r.n_removed) for r in found} == {(1, 0), (2, 200), (3, 400)}
        return {r.doc_id: len(r.factors) for r in found}, len(found)

    assert factors(1) == (factors(300)[0], 3) and factors(300)[1] == 302
