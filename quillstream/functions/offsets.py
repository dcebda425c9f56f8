"""Offsets in the response as it was written, for ranges of the normalized one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_WS = "\\s\ufeff"
_MARKER = rf"[BFTCNP][0-9]+[a-z]?[{_WS}]?[-–—]"
#: The steps of text.normalize(): what is found, and what it becomes, as (text, how far into the match it stands).
_STEPS = (
    (re.compile("\r\n?"), lambda m: [("\n", 0)]),
    (re.compile(rf"([^{_WS}])({_MARKER})"), lambda m: [(m[1], 0), ("\n", 0), (m[2], 1)]),
    (re.compile(rf" ({_MARKER})"), lambda m: [("\n", 0), (m[1], 1)]),
    (re.compile(r"\\\["), lambda m: [("[", 1)]),
)


def origins(raw: str) -> list[int]:
    """For each character of the normalized text, where it comes from."""
    text, places = raw, list(range(len(raw)))
    for pattern, parts in _STEPS:
        new, origin, at = [], [], 0
        for m in pattern.finditer(text):
            new.append(text[at : m.start()])
            origin += places[at : m.start()]
            for part, step in parts(m):
                new.append(part)
                origin += [places[m.start() + step + (k if len(part) > 1 else 0)] for k in range(len(part))]
            at = m.end()
        text, places = "".join(new) + text[at:], origin + places[at:]
    return places


def raw_range(places: list[int], size: int, start: int, end: int) -> tuple[int, int]:
    if not places:
        return 0, 0
    first = places[start] if start < len(places) else 0
    return (first, first) if end <= start else (first, min(size, places[min(end, len(places)) - 1] + 1))


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@pandas_udf(_RANGES)
def raw_ranges(raw: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The ranges of the raw response for arrays of starts and ends in the normalized one; null for a null response."""
    out = []
    for text, a, b in zip(raw, starts, ends):
        places = origins(text) if text is not None else []
        out.append(None if text is None else [dict(zip(("start", "end"), raw_range(places, len(text), x, y))) for x, y in zip(a, b)])
    return pd.Series(out)
