import random
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.functions import diff
from quillstream.operators import patches


def distance(a, b):
    """Insertions and deletions of a shortest script, by dynamic programming over all pairs of places."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] if x == y else 1 + min(above[j], row[-1]))
    return row[-1]


def greedy(a, b):
    """The same search with a whole trace, one diagonal after the other."""
    n, m, trace, reach = len(a), len(b), [], {1: 0}
    for d in range(n + m + 1):
        here = {}
        for k in range(-d, d + 1, 2):
            up, down = reach.get(k + 1, -1) if d else 0, reach.get(k - 1, -1) if d else -1
            down = down + 1 if 0 <= down < n else -1
            up = up if up >= 0 and up - k <= m else -1
            x = up if down < 0 or (up >= 0 and down - 1 < up) else down
            if x < 0:
                continue
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            here[k] = x
        trace.append(here)
        reach = here
        if here.get(n - m, -1) >= n:
            break
    marks, x, k = [], n, n - m
    for d in range(len(trace) - 1, 0, -1):
        up, down = trace[d - 1].get(k + 1, -1), trace[d - 1].get(k - 1, -1)
        down = down + 1 if 0 <= down < n else -1
        up = up if up >= 0 and up - k <= m else -1
        if down < 0 or (up >= 0 and down - 1 < up):
            marks.append((up, up, up - k - 1, up - k))
            k += 1
        else:
            marks.append((down - 1, down, down - k, down - k))
            k -= 1
    out = []
    for i0, i1, j0, j1 in reversed(marks):
        if out and out[-1][1] == i0 and out[-1][3] == j0:
            out[-1] = (out[-1][0], i1, out[-1][2], j1)
        else:
            out.append((i0, i1, j0, j1))
    return out


def rebuilt(a, b, ranges):
    out, at = [], 0
    for i0, i1, j0, j1 in ranges:
        assert i0 >= at and (i1 > i0 or j1 > j0)
        out += [a[at:i0], b[j0:j1]]
        at = i1
    return "".join(out) + a[at:]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_scripts_are_shortest_and_those_of_the_greedy_search(a, b):
    ranges = diff.differences(a, b)
    assert rebuilt(a, b, ranges) == b
    assert sum(i1 - i0 + j1 - j0 for i0, i1, j0, j1 in ranges) == distance(a, b)
    assert ranges == greedy(a, b)


def test_long_scripts_go_back_over_kept_frontiers():
    rng = random.Random(1)
    for n in (300, 700):
        a, b = ("".join(rng.choice("abcd") for _ in range(n + rng.randrange(50))) for _ in range(2))
        assert diff.differences(a, b) == greedy(a, b)


def test_known_scripts():
    assert diff.differences("", "") == [] and diff.differences("x", "") == [(0, 1, 0, 0)] and diff.differences("", "xy") == [(0, 0, 0, 2)]
    assert diff.differences("abcabba", "cbabac") == greedy("abcabba", "cbabac")
    assert diff.differences("a😀b", "a😀😀b") == [(2, 2, 2, 3)] and diff.differences("ab\ud800", "ab") == [(2, 3, 2, 2)]


def test_a_megabyte_in_bounded_memory_and_seconds():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    parts, at = [], 0
    for cut in sorted(rng.sample(range(len(a)), 300)):
        parts += [a[at:cut], rng.choice(["", "XYZ", "a"])]
        at = cut + rng.randrange(4)
    b = "".join([*parts, a[at:]])
    began = time.time()
    tracemalloc.start()
    ranges = diff.differences(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rebuilt(a, b, ranges) == b and len(ranges) > 100
    assert peak < 150e6 and time.time() - began < 60


@pytest.mark.parametrize("seed", range(30))
def test_a_proved_replacement_is_what_the_whole_script_gives(seed, monkeypatch):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abc defghijklmnop") for _ in range(rng.randrange(5, 400))) for _ in range(2))
    b = rng.choice([b, a[:50] + b, b + a[-40:], a[:20] + b + a[-20:]])
    monkeypatch.setattr(patches, "LONG", 0)
    fast = patches.edits(a, b)
    monkeypatch.setattr(patches, "LONG", 10**9)
    assert fast == patches.edits(a, b)


def test_unrelated_long_texts_take_no_time():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     \n") for _ in range(n))
    same = make(30_000)
    for a, b in ((make(100_000), make(100_000)), ("x" + make(60_000) + same, "y" + make(60_000) + same)):
        began = time.time()
        assert len(patches.edits(a, b)) == 1 and time.time() - began < 10


def test_runs_against_all_windows():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, 60).astype(np.uint32), rng.integers(0, 4, 50).astype(np.uint32)
        for size in (1, 3, 5, 60):
            there = [tuple(a[i : i + size]) for i in range(61 - size)]
            assert diff.shares_run(a, b, size) == any(tuple(b[j : j + size]) in there for j in range(51 - size))
            assert diff.repeats_run(a, size) == (len(set(there)) < len(there))


def test_a_short_script_is_the_same_found_near_or_far_and_is_found_fast():
    rng = random.Random(8)
    for t in range(300):
        kinds = ("a", "ab", "abcdefgh")[t % 3]
        a = "".join(rng.choice(kinds) for _ in range(rng.randrange(1, 120)))
        b = "".join(rng.choice(kinds + "z") if rng.random() < 0.1 else c for c in a) + "z"
        near = diff._near(a, b, 10_000)
        assert near == diff._far(diff.code_points(a), diff.code_points(b))
        assert diff._near(a, b, len(near) - 1) is None
    words = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400))
    edited = "start " + words[:900] + words[900:920].upper() + words[920:] + " end"
    begun = time.process_time()
    for _ in range(200):
        diff.differences(words, edited)
    assert time.process_time() - begun < 1.2  # over 2 s with numpy's calls for each distance
