from collections import Counter

import pytest

from quillstream.llm import mixing


def test_water_fill_reshares_the_excess():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.water_fill([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.water_fill([0, 10], [5, 2]) == [0.0, 10.0]
    assert mixing.water_fill([], []) == []
    sizes, weights = [3, 900, 40, 7, 0, 250], mixing.cycle_weights(6)
    targets = mixing.water_fill(sizes, weights)
    assert sum(targets) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s for t, s in zip(targets, sizes))


def brute(rows, block=32):
    """The mix by walking all slots."""
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in order]
    targets = mixing.water_fill(sizes, mixing.cycle_weights(len(order)))
    bounds = mixing._bounds(targets, sum(sizes))
    taken = Counter()
    import hashlib

    streams = []
    for s in order:
        docs = sorted((r for r in rows if r[2] == s and r[1].split()), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest())
        streams.append([d[0] for d in docs for _ in d[1].split()] * 3)
    used = [0] * len(order)
    for slot in range(-(-sum(sizes) // block)):
        point = slot * mixing.GOLDEN % mixing.GRID
        s = next(i for i in range(len(order)) if bounds[i] <= point < bounds[i + 1])
        taken.update(streams[s][used[s] : used[s] + block])
        used[s] += block
    return taken, dict(zip(order, targets))


def test_matches_a_walk_over_all_slots(documents):
    rows = [(i, " ".join(["w"] * (i * 37 % 200)), "en", "abcd"[i % 4] if i % 9 else None) for i in range(120)]
    pieces, found = mixing.mix(documents(rows), chunk=7)
    taken, targets = brute([(r[0], r[1], r[3]) for r in rows])
    out = found.collect()
    assert {r.doc_id: r.taken for r in out} == {r[0]: taken[r[0]] for r in rows}
    assert all(r.target == targets[r.source] and r.taken <= 3 * r.size for r in out)
    assert sum(r.n_words for r in pieces.collect()) == sum(taken.values())


def test_awkward_rows_and_no_rows(documents, awkward):
    out = mixing.mix(documents(awkward))[1].collect()
    assert len(out) == len(awkward)
    assert {r.doc_id: r.size for r in out}[1] == 0 and all(r.taken == 0 for r in out if not r.size)
    pieces, found = mixing.mix(documents([]))
    assert found.count() == 0 and pieces.count() == 0


def test_reruns_agree(documents, awkward):
    runs = [sorted(map(tuple, mixing.mix(documents(awkward))[1].select("doc_id", "size", "taken").collect()), key=str) for _ in range(2)]
    assert runs[0] == runs[1]
