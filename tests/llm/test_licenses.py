import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import licenses
from quillstream.llm.common import ALNUM_WORDS, Tokens
from quillstream.llm.license_rules import BASE, rules
from quillstream.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CASES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "© 2019 Somebody. All rights reserved.": "reserved",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later",
    "the GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Dieses Werk ist lizenziert unter der CC BY-SA 3.0": "cc-by,cc-by-sa-3.0",
    "publié sous licence MIT": "mit",
    "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
    "https://creativecommons.org/licenses/by/4.0/": "cc-by-4.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "GPLv3": "gpl-3.0",
    "Er ging mit der Lizenz nach Hause, das ist alles": "",
    "the apache people, an open license plate, under the sea": "",
    "by commons general public opinion, all rights are reserved": "",
}


def brute(text):
    """Every rule over the whole text without keywords, and each finding against every other."""
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    line = f" {' '.join(words)} "
    where = lambda i: line[: i + 1].count(" ") - 1
    found = []
    for k, r in enumerate(rules()):
        found += [(where(m.start()), where(m.end()), r.priority, k, r) for m in re.finditer(f" (?:{r.pattern})(?= )", line)]
    kept = []
    for x in found:
        inside = lambda y: y[0] <= x[0] and x[1] <= y[1] and (y[2] < x[2] or y[2] == x[2] and ((y[0], y[1]) != (x[0], x[1]) or y[3] < x[3]))  # noqa: B023, E731
        if not any(inside(y) for y in found):
            kept.append(x)
    base = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in base]
    labels = sorted({x[4].label for x in kept} | {label for _, label in base})
    score = max([x[4].weight for x in kept] + [0.5] * bool(base) + [0.0])
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(labels), score


def findings(text):
    there = licenses.keywords_in(Tokens(pa.array([text]), ALNUM_WORDS, fold=True))
    return licenses.scan_text(licenses.folded(text), there[0]) if there else []


@pytest.mark.parametrize("text", CASES)
def test_labels(text):
    assert ",".join(sorted({x[2] for x in findings(text)})) == CASES[text]


def test_rules_are_many_and_distinct():
    assert len(rules()) > 300 and len({r.name for r in rules()}) == len(rules()) and [r.priority for r in rules()] == sorted(r.priority for r in rules())


def test_matches_every_rule_without_keywords(documents, awkward):
    rng = random.Random(5)
    pieces = [*CASES, "cc by", "general", "public license", "all rights", "reserved", "cc", "version 3", "mit", "license", "the", "\n", "ä", "or later", "😀", "under", "GNU"]
    rows = [(100 + i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(25)))) for i in range(150)] + [(r[0], r[1]) for r in awkward if len(r[1] or "") < 1000]
    out = licenses.digest(licenses.scan(documents(rows))).collect()
    got = sorted((tuple(r) for r in out), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_survivors_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 14))
        start, size, priority = rng.integers(0, 8, n), rng.integers(1, 6, n), rng.integers(1, 4, n)
        end, keys = start + size, list(range(n))
        better = lambda y, x: priority[y] < priority[x] or priority[y] == priority[x] and ((start[y], end[y]) != (start[x], end[x]) or y < x)  # noqa: B023, E731
        want = [not any(y != x and start[y] <= start[x] and end[x] <= end[y] and better(y, x) for y in keys) for x in keys]
        assert licenses.survivors(start, end, priority).tolist() == want


def test_awkward_rows_kept_columns_and_no_rows(documents, awkward):
    out = licenses.scan(documents(awkward), keep=["lang"]).collect()
    assert len(out) == len(awkward) and {r.doc_id: r.n_words for r in out}[7] == 60_000
    assert licenses.digest(licenses.scan(documents([]))).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(documents([]), keep=["n_words"])
    many = findings("Licensed under the MIT License. " * 20_000)
    assert len(many) == 20_000


def test_base_columns_match_sql(spark):
    con = duckdb.connect()
    base = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    sql = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM read_parquet('{SF}/documents.parquet')),
    b AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}', {len(v.split())})" for k, v in base.items())}) t(label, phrase, n)),
    h AS (SELECT doc_id, i - 1 AS i, label FROM d, b, unnest(range(1, len(w) - n + 2)) u(i) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase)
    SELECT d.doc_id, len(any_value(w)), count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id
    """
    out = QUERIES["op13_license_scan"](spark, SF).collect()
    assert sorted(tuple(r)[:6] for r in out) == sorted(con.execute(sql).fetchall())
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
