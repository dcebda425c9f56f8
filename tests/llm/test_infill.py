import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.llm import infill

UNITS = {
    "letters": (infill.LETTERS, r"[A-Za-z]+|[^A-Za-z]"),
    "spaced": (infill.SPACED, r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"),
    "lines": (infill.LINES, r"[^\n]*\n|[^\n]+"),
    "code points": (infill.CODE_POINTS, r"(?s)."),
}


def brute(doc_id, text, pattern=UNITS["letters"][1]):
    text = text or ""
    tokens = re.findall(pattern, text)
    n = len(tokens)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def samples(awkward):
    rng = random.Random(3)
    alphabet = "abZ .\n\r\t \u0085\x00ä漢😀\U0010ffff́<PSM>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [r[:2] for r in awkward] + [(100 + i, t) for i, t in enumerate([*texts, "a<P>b", "<", "<S", "M>", "😀", "\n", "\n\n", "a\n", "<<", ">P>x"])]


@pytest.mark.parametrize("name", UNITS)
def test_units_are_those_of_the_grammar(spark, awkward, name):
    grammar, pattern = UNITS[name]
    rows = samples(awkward)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("text", infill.units(F.col("text"), grammar).alias("units"))
    for r in df.collect():
        assert r.units == (None if r.text is None else re.findall(pattern, r.text))


def test_matches_brute_force_and_round_trips(documents, awkward):
    rows = samples(awkward)
    out = infill.transform(documents(rows))
    found = infill.digest(out).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = brute(doc_id, text)
        want.append((doc_id, n, form, prefix, middle, sha(output), sha(text or "")))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_every_form_restores_whatever_the_cuts(documents):
    texts = ["ab <", "P> ab", "<<S", "x", "😀<M😀>"]
    for seed in range(8):
        out = infill.transform(documents([(i, t) for i, t in enumerate(texts)]), seed=seed, rates=infill.Rates(100, 50))
        for r in out.select("doc_id", "form", infill.restored(F.col("output"), F.col("form")).alias("again")).collect():
            assert r.form != "plain" and r.again == texts[r.doc_id]


def test_no_rows_more_columns_and_no_shuffle(documents):
    assert infill.transform(documents([])).count() == 0
    out = infill.transform(documents([(1, "a b")]).withColumnRenamed("spans", "Form"))
    assert [c.lower() for c in out.columns].count("form") == 1 and "component_id" in out.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange")) and plan.count("split(") <= 2
