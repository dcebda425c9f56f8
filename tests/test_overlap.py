import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.functions.overlap import best_overlap


def walk(prompt, found):
    """The rule read out from every place, with the ids ahead as a set."""
    known, best = set(found), None
    for start, name in enumerate(prompt):
        if name not in known:
            continue
        ahead, p, r, hits, last = set(prompt[start:]), start, 0, 0, start - 1
        while p < len(prompt) and r < len(found):
            if prompt[p] == found[r]:
                hits, last = hits + 1, p
                ahead.discard(prompt[p])
                p, r = p + 1, r + 1
            elif prompt[p] in known and found[r] not in ahead:
                r += 1
            else:
                ahead.discard(prompt[p])
                p += 1
        rank = (hits, -(last - start + 1), start, last)
        if hits and (best is None or rank > best[0]):
            best = rank, (start, last + 1)
    return best and best[1]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from("ABCDEF"), max_size=14), st.lists(st.sampled_from("ABCDEFX"), max_size=10))
def test_equals_the_walk_on_random_lists(prompt, found):
    assert best_overlap(prompt, found) == walk(prompt, found)


@settings(max_examples=500, deadline=None)
@given(st.permutations("ABCDEFGHIJ"), st.lists(st.sampled_from("ABCDEFGHIJX"), max_size=14), st.integers(0, 10))
def test_equals_the_walk_where_no_id_stands_twice(prompt, found, size):
    assert best_overlap(prompt[:size], found) == walk(prompt[:size], found)


@pytest.mark.parametrize("seed", range(25))
def test_equals_the_walk_on_sources_with_examples_and_repeats(seed):
    rng = random.Random(seed)
    source = [f"P{i}" for i in range(rng.randrange(1, 60))]
    prompt = rng.choice([source[:5] + ["E"] + source, source + source, source, source[::2] + source[1::2] + source])
    found = [rng.choice([x, x, x, x, "Z", rng.choice(source)]) for x in source if rng.random() < 0.9]
    assert best_overlap(prompt, found) == walk(prompt, found)


@pytest.mark.parametrize("twice", [False, True])
def test_a_hundred_thousand_segments_in_seconds(twice):
    rng = random.Random(3)
    source = [f"P{i}" for i in range(50_000 if twice else 100_000)]
    found = [x for x in source if rng.random() < 0.999]
    for _ in range(20):
        found[rng.randrange(len(found))] = "invented"
    prompt = source + source if twice else ["P7", "P9"] + source
    began = time.time()
    start, end = best_overlap(prompt, found)
    assert time.time() - began < 20
    assert prompt[start] == found[0] and end == len(prompt) - (source[-1] != found[-1]) and start >= len(prompt) - len(source)
