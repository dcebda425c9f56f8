import hashlib
import random
import re

from quillstream.llm import secret_examples as e
from quillstream.llm import secrets as s
from .conftest import prose


def brute(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def plant(rng):
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 23, 24, 40])))
    akia = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(rng.choice([12, 16, 17])))
    return rng.choice([f"password={hexes}", f'Token = "{hexes}"', akia, f"api_key: '{hexes}'", f"SECRET:{hexes[:5]}", hexes, f"x{akia}y", "https://example.org/2024/some-long-path", "4055105915866795", "paſſwd=abcdefgh"])


def test_base_findings_match_brute_force(documents):
    rng = random.Random(0)
    rows = []
    for i in range(300):
        w = prose(rng, rng.randrange(30)).split() + ["ünï 😀"]
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w)), plant(rng))
        rows.append((i, " ".join(w)))
    docs = documents(rows)
    for r in s.digest(s.scan(docs, s.train(docs))).collect():
        base = brute(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())
        assert [x for x in r.spans.split(",") if x and not x.startswith("net")] == base


def test_finds_planted_secrets_that_no_pattern_knows(documents):
    """Held-out plants: of another seed than the training's, and of kinds of their own (three words of context, other leads)."""
    rng = random.Random(77)
    rows, wanted = [], {}
    for i in range(800):
        label = i % 2 == 0
        found = (e.secret if label else e.plain)(rng)
        left = " ".join(e.word(rng) for _ in range(3)) + rng.choice([" ", " is ", ": ", ' "'])
        rows.append((i, left + found + " " + " ".join(e.word(rng) for _ in range(3))))
        if not s.base_spans(rows[-1][1]):
            wanted[i] = label
    docs = documents(rows)
    found = {r.doc_id: any(x.kind == "net" for x in r.spans) for r in s.scan(docs, s.train(documents([]))).collect()}
    secrets, others = [found[i] for i, label in wanted.items() if label], [found[i] for i, label in wanted.items() if not label]
    print("recall", sum(secrets) / len(secrets), "false positives", sum(others) / len(others))
    assert len(secrets) > 200 and sum(secrets) >= 0.95 * len(secrets) and sum(others) <= 0.05 * len(others)


def test_made_examples_are_candidates_and_plain_ones_look_so():
    for text, start, end, label in e.examples(2000):
        assert s.CANDIDATE.search(text, start) and s.CANDIDATE.search(text)[0] in text
        assert end - start >= 16 and any(c.isdigit() for c in text[start:end])
        if not label:
            assert s.is_plain(text[start:end]) or any(c in text[start:end] for c in "xb12T")
    assert s.is_plain("mail3.example.com") and s.is_plain("4512160218721939") and not s.is_plain("a8f3k2m9x7q4z1w6")


def test_network_learns_and_keeps_the_recall():
    rng = random.Random(1)
    views, labels = [], []
    for _ in range(600):
        secret = "".join(rng.choice("0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randrange(20, 45)))
        plain = rng.choice(["https://example.org/2024/", "page-number-12-", "file_2023_report_"]) + "".join(rng.choice("aeioun-") for _ in range(15))
        for text, label in ((f"the key = {secret} and", True), (f"see also {plain} and", False)):
            start = text.index(secret if label else plain)
            views.append(s.view(text, start, start + len(secret if label else plain))), labels.append(label)
    net = s.fit(views, labels)
    p = net.probability(s.encode(views))
    accepted = p >= net.threshold
    assert sum(a for a, y in zip(accepted, labels) if y) / 600 >= 0.97 and sum(a for a, y in zip(accepted, labels) if not y) / 600 <= 0.02
    assert s.fit(views[:4], labels[:4]).threshold > 1  # nothing to learn from: nothing is accepted


def test_view_is_of_one_length():
    for start, end in ((0, 16), (5, 90), (50, 100)):
        assert len(s.view("x" * 100, start, end)) == s.LEFT + s.BODY + s.RIGHT


def test_awkward_rows_and_no_rows(documents, awkward):
    docs = documents(awkward)
    out = s.digest(s.scan(docs, s.train(docs))).collect()
    assert len(out) == len(awkward) and all(r.spans == "" for r in out if r.doc_id in (1, 2, 3))
    empty = documents([])
    assert s.scan(empty, s.train(empty)).count() == 0


def test_threshold_keeps_the_recall_where_secrets_are_rare():
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(30))
    views, labels = [s.view(key(), 0, 30) for _ in range(1500)], [i % 50 == 0 for i in range(1500)]  # nothing tells them apart
    net = s.fit(views, labels)
    assert net.threshold < 0.5


def test_sample_holds_the_findings_of_all_documents(documents):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("ghijklm0123456789") for _ in range(30))
    rows = [(i, ("password=" if i % 20 == 0 else "see ") + key() + "1") for i in range(600)]
    assert s.train(documents(rows)).threshold <= 1


def test_long_candidates_are_read_whole():
    for n in (16, 48, 49, 72, 73, 200, 1000):
        parts = s.windows(5, 5 + n)
        assert parts[0][0] == 5 and parts[-1][1] == 5 + n and all(e - b <= s.BODY for b, e in parts)
        assert all(any(b <= i and i + min(n, 24) <= e for b, e in parts) for i in range(5, 5 + n - min(n, 24) + 1))


def test_all_findings_of_the_documents_train_and_calibrate(documents):
    """Beyond any bound on a label, in groups whose number doesn't depend on partitions."""
    rng = random.Random(6)
    rows = [(i, "see page-%d-of-%s and password=k%015d" % (i, e.word(rng, 9), rng.randrange(10**15))) for i in range(4_500)]
    docs = documents(rows)
    net = s.train(docs, made=600, epochs=2)
    assert net.trained + net.held == 9_000 and 1_700 < net.held <= 1_800
    again = s.train(docs.repartition(7), made=600, epochs=2)
    assert net.threshold == again.threshold and all((net.weights[k] == again.weights[k]).all() for k in net.weights)


def test_training_in_many_groups_finds_what_one_does(documents):
    rng = random.Random(7)
    rows = [(i, f"{e.word(rng)} " + ("password=" + e.secret(rng) if i % 2 else "see " + e.plain(rng))) for i in range(1_000)]
    net = s.train(documents(rows), group=100)
    views, labels = zip(*((s.view(t, a, b), y) for t, a, b, y in e.examples(1_000, seed=99)))
    accepted = net.probability(s.encode(list(views))) >= net.threshold
    assert sum(a for a, y in zip(accepted, labels) if y) >= 0.95 * 500 and sum(a for a, y in zip(accepted, labels) if not y) <= 0.05 * 500
