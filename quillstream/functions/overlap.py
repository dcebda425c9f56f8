"""The part of one list of ids that best holds another in order, without walking it anew from every place."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np

Found = tuple[int, int, int, int]  # hits, -(length of the range), start, end (exclusive): the greatest is the best


def best_overlap(prompt: list[str], found: list[str]) -> tuple[int, int] | None:
    """The prompt range (from 0, end exclusive) with the most of the response's ids in order; of equal ones the shortest, then the last.

    The rule, from each place that has one of these ids: both lists are read in step; a prompt id that the response lacks is
    passed over, and so is a response id that lies no more ahead, which is one whose first place from the start on was read already; other
    prompt ids are passed over until the response's turns up.
    """
    known = set(found)
    places = [i for i, name in enumerate(prompt) if name in known]
    if not places:
        return None
    there = {name: k for k, name in enumerate(dict.fromkeys(prompt[i] for i in places))}
    line = [there[prompt[i]] for i in places]
    wanted = [there[name] for name in found if name in there]  # the others are passed over wherever they come
    hits, size, start, end = _distinct(line, wanted, places) if len(there) == len(line) else _repeated(line, wanted, places)
    return (start, end) if hits else None


def _distinct(line: list[int], wanted: list[int], places: list[int]) -> Found:
    """No id stands twice in the prompt, so what follows a hit doesn't depend on the start: from the hit of one response id the
    next is of the first later one that stands further on. Chains of these are counted from the back; n log n in all."""
    at = [0] * len(line)
    for k, name in enumerate(line):
        at[name] = k
    spot = [at[name] for name in wanted]
    m = len(spot)
    count, last, after = [0] * m, [0] * m, []
    for r in range(m - 1, -1, -1):
        while after and spot[after[-1]] <= spot[r]:
            after.pop()
        count[r], last[r] = (count[after[-1]] + 1, last[after[-1]]) if after else (1, spot[r])
        after.append(r)
    reach = list(accumulate(spot, max))
    best = (0, 0, 0, 0)
    for start in range(len(line)):
        r = bisect_left(reach, start)  # the first response id that is still ahead
        if r < m:
            best = max(best, (count[r], places[start] - places[last[r]] - 1, places[start], places[last[r]] + 1))
    return best


def _same(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How long both lists agree from i and j on."""
    total, width = 0, 16
    while True:
        left, right = a[i : i + width], b[j : j + width]
        n = min(len(left), len(right))
        unlike = np.flatnonzero(left[:n] != right[:n])
        if len(unlike):
            return total + int(unlike[0])
        total += n
        if n < width:
            return total
        i, j, width = i + n, j + n, width * 2


#: So many of the response's first ids show where to begin the search: their places are likely starts.
LIKELY = 16


def _repeated(line: list[int], wanted: list[int], places: list[int]) -> Found:
    """Ids may stand more than once in the prompt: each start is followed by its runs of equal ids and its jumps, and left as soon as it can't win.

    Likely starts come first, for a high mark. Another is left when too few response ids are left to reach it, or when it could only draw and
    its range would be longer. Lists that repeat their ids in other orders throughout are the worst case: as many steps from each
    start as it has runs.
    """
    a, b, m = np.array(line, np.int64), np.array(wanted, np.int64), len(wanted)
    where: list[list[int]] = [[] for _ in range(int(a.max()) + 1)]
    for k, name in enumerate(line):
        where[name].append(k)
    last = [w[-1] for w in where]
    reach = list(accumulate((last[name] for name in wanted), max))
    best = (0, 0, 0, 0)
    likely = [k for name in dict.fromkeys(wanted[:LIKELY]) for k in reversed(where[name])] if m else []
    for start in [*likely, *range(len(line) - 1, -1, -1)]:
        r = bisect_left(reach, start)  # the first response id that is still ahead
        p, hits, end = start, 0, start - 1
        while p < len(line) and r < m:
            most = hits + min(m - r, len(line) - p)
            if most < best[0]:
                break
            need = max(best[0] - hits, 1)
            if most == best[0] and places[p + need - 1] - places[start] + 1 > -best[1]:
                break
            if line[p] == wanted[r]:
                run = _same(a, p, b, r)
                hits, p, r, end = hits + run, p + run, r + run, p + run - 1
                continue
            name = wanted[r]
            if last[name] >= p:
                spots = where[name]
                ahead = spots[bisect_left(spots, start)]
                if ahead >= p:  # pass over the prompt's ids up to it
                    p = ahead
                    continue
            r += 1
        if hits:
            best = max(best, (hits, places[start] - places[end] - 1, places[start], places[end] + 1))
    return best
