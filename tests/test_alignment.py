import pytest

from quillstream.functions.overlap import best_overlap
from quillstream.operators.alignment import align
from pyspark.sql import functions as F


def segs(names):
    return [(n, f"t{n}") for n in names]


@pytest.mark.parametrize(
    ("prompt", "found", "wanted"),
    [
        ("A B A B C".split(), "A B C".split(), (2, 5)), ("A B C".split(), "A X C".split(), (0, 3)), ("A B C D".split(), "B D".split(), (1, 4)), ("A B".split(), ["Z"], None),
        ("A A B".split(), "A B".split(), (1, 3)), ("P1 P2 P9 P1 P2 P3".split(), "P1 P3".split(), (3, 6)),
    ],
)
def test_best_overlap(prompt, found, wanted):
    assert best_overlap(prompt, found) == wanted


def test_align(spark):
    kind = "array<struct<id:string,text:string>>"
    rows = [(0, segs("XABC"), segs("ABC")), (1, segs("ABCABC"), segs("ABC")), (2, segs("EABCD"), segs("AXD")), (3, segs("AB"), segs("ABC")), (4, segs("AB"), []), (5, segs("AB"), segs("YZ"))]
    out = {r.n: r for r in align(spark.createDataFrame(rows, f"n int, prompt_segments {kind}, segments {kind}")).select("n", F.transform("source", lambda s: s["id"]).alias("ids"), "aligned").collect()}
    assert {n: ("".join(r.ids), r.aligned) for n, r in out.items()} == {0: ("ABC", True), 1: ("ABC", True), 2: ("ABCD", True), 3: ("AB", False), 4: ("AB", False), 5: ("AB", False)}
