import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words string, kept string, component_id string, items string"


def prose(rng: random.Random, n: int, kinds: int = 400) -> str:
    """n words of an invented language, in lines."""
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    return " ".join(w + (".\n" if rng.random() < 0.08 else "") for w in words).replace("\n ", "\n") + "."


@pytest.fixture
def documents(spark):
    """Makes a documents table, with more columns whose names clash with results, of (doc_id, text[, lang, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), None, "s", "w", "k", "c", "i")[:10] for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def awkward():
    """Null, empty, blank, wordless, one-word and very long texts, in several scripts, and repeated rows."""
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    return [
        (1, None, None, None), (2, "", "en", None), (3, " \t\n \x0b", "en", "a"), (4, "!!! ... ---", "en", "a"), (5, "one", "en", "a"), (6, "ünïcödé 😀 çà b", "fr", "b"),
        (7, long, "en", "a"), (8, long + " tail", "en", "b"), (9, "same text here", "en", "a"), (9, "same text here", "en", "a"), (10, "same text here", "en", "a"), (11, "\x00nul\x00 ﻿ bom", None, "a"),
        (None, "no id at all", "en", "a"),
    ]
