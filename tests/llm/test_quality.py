import random
from collections import Counter

from quillstream.llm import quality as q
from .conftest import prose


def brute(t):
    t = t or ""
    w = t.split() if all(c.isascii() for c in t) else [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p + k for p, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def test_counts_match_brute_force(documents, awkward):
    rng = random.Random(0)
    rows = [(i, prose(rng, rng.randrange(0, 200), rng.choice([3, 8, 400])).replace("w1", rng.choice(["#a|", "x", "é"]))) for i in range(100)]
    rows += [(1000 + i, r[1]) for i, r in enumerate(awkward)]
    for r in q.quality(documents(rows)).collect():
        assert (int(r.n_words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(dict(rows)[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_lines_are_judged_one_by_one(documents):
    good = "This is a plain line of prose with quite a few words in it, and it ends well.\n"
    bad = ["Home | About | Contact | Help | More", "BUY NOW AND SAVE YOUR MONEY TODAY!!", "a### b$$$ c%%% d&&& e***", "go go go go go go now.", "All rights reserved.", "menu"]
    rows = [(i, good * 6 + b + "\n" + good) for i, b in enumerate(bad)] + [(50, good * 8), (51, "\n".join(bad * 4) + "\n" + good * 4)]
    out = {r.doc_id: r for r in q.quality(documents(rows)).collect()}
    for i, b in enumerate(bad):
        assert b not in out[i].clean_text and good in out[i].clean_text, b
    assert out[50].clean_text == good * 8
    distinct = "".join(f"Line {k} tells of thing {k * 7} and place {k * 11} in some words of {k * 13}.\n" for k in range(9))
    kept = {r.doc_id: r.kept for r in q.quality(documents([(1, distinct), (2, distinct + "x### y$$$ z%%% " * 40), (3, "few words")])).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_columns_that_clash_and_no_rows(documents):
    out = q.quality(documents([(1, "a b c")]))
    assert out.columns.count("n_words") == 1 and out.columns.count("kept") == 1 and "spans" in out.columns
    assert q.quality(documents([])).count() == 0
    nodes = q.quality(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in nodes for x in ("Python", "Pandas", "Arrow", "Exchange"))
