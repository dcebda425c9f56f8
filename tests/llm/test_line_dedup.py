import random

import pytest
from pyspark.sql import functions as F

from quillstream.llm import line_dedup as ld
from quillstream.llm.queries import op6_line_dedup


def brute(rows, min_words=8, share=0.1):
    """The same rules over all documents in plain Python; line equality by text."""
    split = {i: [x.strip(" \t\r\x0b\x0c") if x.split() else None for x in t.split("\n")] for i, t in rows if t is not None}
    words = {i: [len(x.split()) for x in t.split("\n")] for i, t in rows if t is not None}
    leaders, gone = {}, {i: set() for i, _ in rows}
    for i in sorted(split):
        leaders.setdefault(tuple(split[i]), i)
    lead = {i: leaders[tuple(split[i])] for i in split}
    holders = {}
    for i in sorted(set(leaders.values())):
        for line in set(split[i]) - {None}:
            holders.setdefault(line, []).append(i)
    rare = max(10, int(share * len(leaders)))
    pairs = {(i, h[0]) for h in holders.values() if 1 < len(h) <= rare for i in h[1:]}
    for i, first in pairs:
        gone[i] |= set(ld.common_blocks(split[first], split[i], words[i], min_words))
    for i in split:
        if lead[i] != i and sum(words[i]) >= min_words:
            gone[i] |= {k for k, x in enumerate(split[i]) if x is not None}
    return {i: sorted(g) for i, g in gone.items()}


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(documents, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 14)))
    pool = [line() for _ in range(40)]
    rows = []
    for i in range(120):
        lines = [line() if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randrange(0, 9))]
        if rng.random() < 0.2 and rows:
            lines = rng.choice(rows)[1].split("\n")[: rng.randrange(1, 9)]
        rows.append((i, "\n".join(lines + ["common to all of them"] * (rng.random() < 0.5) + [""] * rng.randrange(2))))
    found = {r.doc_id: r for r in ld.deduplicate_lines(documents(rows)).collect()}
    wanted = brute(rows)
    assert {i: r.removed_lines for i, r in found.items()} == wanted
    for i, t in rows:
        assert found[i].clean_text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in wanted[i])


def test_patience_alignment():
    assert ld.patience("abc", "abc") == [(0, 0), (1, 1), (2, 2)]
    assert ld.patience("axbyc", "abzc") == [(0, 0), (2, 1), (4, 3)]
    assert ld.patience("ab", "ba") in ([(0, 1)], [(1, 0)])
    assert ld.patience([None, 1], [None, 1]) == [(1, 1)]
    assert ld.patience([], "a") == []
    for seed in range(50):
        rng = random.Random(seed)
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        out = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in out) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(out, out[1:]))


def test_awkward_rows_and_no_rows(documents, awkward):
    out = ld.deduplicate_lines(documents(awkward), keep=("source", "spans")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(awkward) and by[1].clean_text is None and by[1].n_lines == 0 and by[2].clean_text == "" and by[10].removed_lines == []
    assert out[0].spans == "s"
    assert ld.deduplicate_lines(documents([])).count() == 0


def test_copies_keep_the_first_alone(documents):
    text = "one two three four five six seven eight nine\nten eleven"
    found = {r.doc_id: r.clean_text for r in ld.deduplicate_lines(documents([(i, text) for i in (5, 2, 9)] + [(10, text + "\nmore of it here")])).collect()}
    assert found == {2: text, 5: "", 9: "", 10: "more of it here"}


def test_passage_of_a_third_of_all_documents(spark, tmp_path):
    licence = "this line stands in a third of all documents and is long\nit has\nmore short\nlines in a row that count"
    own = lambda i: f"body {i} of its own with words enough to count {i}"
    rows = [(i, own(i) + ("\n" + licence if i % 3 == 0 else "")) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.removed_lines for r in op6_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {i: "1,2,3,4" if i % 3 == 0 and i else "" for i in range(150)}


def exact(rows, min_words=8):
    """By text alone, without alignment or pairs: lines in a run of min_words that a row of an earlier id has go. One list for each row."""
    seen, whole, gone = set(), set(), []
    fresh = lambda text: [x.strip(" \t\r\x0b\x0c") if x.split() else None for x in text.split("\n")]
    spans = lambda lines, sizes: [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if None not in lines[a:b] and sum(sizes[a:b]) >= min_words]
    for i in sorted({i for i, _ in rows if i is not None}):
        own = [(fresh(t), [len(x.split()) for x in t.split("\n")]) for j, t in rows if j == i]
        for (lines, sizes), text in zip(own, (t for j, t in rows if j == i)):
            if tuple(lines) in whole:
                found = [k for k, x in enumerate(lines) if x is not None] if sum(sizes) >= min_words else []
            else:
                found = sorted({k for a, b in spans(lines, sizes) if tuple(lines[a:b]) in seen for k in range(a, b)})
            gone.append((i, text, found))
        for lines, sizes in own:
            whole.add(tuple(lines))
            seen |= {tuple(lines[a:b]) for a, b in spans(lines, sizes)}
    return gone + [(i, t, []) for i, t in rows if i is None]


def test_matches_independent_brute_force(documents):
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 14)))
    pool = [line() for _ in range(15)]
    rows = []
    for i in range(150):
        lines = [rng.choice([line(), rng.choice(pool), rng.choice(pool), ""]) for _ in range(rng.randrange(1, 10))]
        if rows and rng.random() < 0.3:
            lines += rng.choice(rows)[1].split("\n")[rng.randrange(3) :]
        rows.append((i, "\n".join(lines)))
    found = {r.doc_id: r.removed_lines for r in ld.deduplicate_lines(documents(rows), rare_share=None).collect()}
    assert found == {i: gone for i, _, gone in exact(rows)}
    # rows of one id, and of none
    rows = [(None if k % 17 == 0 else i // 3, t) for k, (i, t) in enumerate(rows + rows[:20])]
    out = ld.deduplicate_lines(documents(rows).withColumn("input", F.col("text")), rare_share=None, keep=("input",)).collect()
    assert sorted((str(r.doc_id), r.input, r.removed_lines) for r in out) == sorted((str(i), t, gone) for i, t, gone in exact(rows))


def test_a_block_meets_every_earlier_holder(documents):
    x, y = "one two three four five", "six seven eight nine ten"
    rows = [(1, f"{x}\nown words of one"), (2, f"{y}\nown words of two"), (3, f"here\n{x}\n{y}\nthree"), (4, f"four\n{x}\n{y}\nmore")]
    found = {r.doc_id: r.removed_lines for r in ld.deduplicate_lines(documents(rows), rare_share=None).collect()}
    assert found == {1: [], 2: [], 3: [], 4: [1, 2]}


def test_repeated_lines_and_blocks_of_short_lines(documents):
    x, y, z, a, b, c = (f"{k} is a line of its own that only one document has" for k in "xyzabc")
    shared = "this passage is shared by both and counts eight words"
    short = ["one two three", "four five six", "seven eight nine"]
    rows = [(1, "\n".join([x, shared, y, shared, z])), (2, "\n".join([a, shared, b, shared, c]))]
    rows += [(3, short[0] + "\nup"), (4, short[1] + "\ndown"), (5, "\n".join(["m n", *short, "o p"])), (6, short[2] + "\nq"), (9, "\n".join(["r s", *short, "t u"]))]
    found = {r.doc_id: r.removed_lines for r in ld.deduplicate_lines(documents(rows), rare_share=None).collect()}
    assert found[1] == [] and found[2] == [1, 3] and found[5] == [] and found[9] == [1, 2, 3]
