import random

import numpy as np
import pytest

from quillstream.llm import lm_score as lm
from .conftest import prose


def chain(rng, n):
    """Words that follow from the one before."""
    out = ["s0"]
    for _ in range(n - 1):
        k = int(out[-1][1:])
        out.append(f"s{(k * 3 + rng.randrange(2)) % 50}")
    return out


def test_order_that_was_learned_scores_higher(documents):
    rng = random.Random(0)
    docs = documents([(i, " ".join(chain(rng, 120)), "en", "a") for i in range(150)])
    words = lm.vocabulary(docs)
    weights = lm.train(lm.numbered(docs, words), words, rounds=3, share=1.0)
    test = [chain(rng, 100) for _ in range(20)]
    mixed = [rng.sample(t, len(t)) for t in test]
    numbers = lm.numbered(documents([(i, " ".join(t)) for i, t in enumerate(test + mixed)]), words)
    out = {r.doc_id: r.mean_log_likelihood for r in lm.score(numbers, words, weights).collect()}
    assert all(out[i] > out[i + 20] for i in range(20))
    # the words' probabilities, in surroundings of the corpus, sum to about one
    leaves = np.array([words.leaves[np.searchsorted(words.hashes, h)] for h in words.hashes])
    around = np.stack([np.random.default_rng(1).permutation(leaves)[: 2 * lm.SIDE] for _ in range(20)])
    points = words.quantiles((np.arange(lm.QUANTILES) + 0.5) / lm.QUANTILES)
    sums = [np.exp(lm.surprise(weights, np.repeat(a[None], len(leaves), 0), leaves, points)) @ words.share[leaves] for a in around]
    assert np.allclose(sums, 1, atol=0.15)


def test_scores_equal_a_word_by_word_sum():
    rng = np.random.default_rng(0)
    w = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in lm.fresh(60).items()}
    leaves, first = rng.integers(0, 60, 30), np.array([0, 1, 1, 12, 30])
    around = lm.contexts(leaves, first, 60)
    for d in range(4):
        for i in range(first[d], first[d + 1]):
            at = [i - 2, i - 1, i + 1, i + 2]
            assert around[i].tolist() == [leaves[j] if first[d] <= j < first[d + 1] else 60 for j in at]
    drawn = rng.integers(0, 60, 10)
    got = lm.surprise(w, around, leaves, drawn, rows=7)
    for i in range(30):
        h = np.append(np.maximum(w["embed"][around[i]].ravel() @ w["hidden"] + w["bias"][0], 0), 1)
        assert abs(got[i] - (h @ w["out"][leaves[i]] - np.log(np.exp(w["out"][drawn] @ h).mean()))) < 1e-4


def test_gradients(monkeypatch):
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in lm.fresh(40).items()}
    around, target, noise = rng.integers(0, 41, (12, 2 * lm.SIDE)), rng.integers(0, 40, 12), rng.integers(0, 40, 9)

    def loss(v):
        _, h = lm._hidden(v, around)
        z = np.concatenate([(h * v["out"][target]).sum(axis=1, keepdims=True), h @ v["out"][noise].T], axis=1)
        return (np.log(np.exp(z).sum(axis=1)) - z[:, 0]).mean()

    monkeypatch.setattr(lm, "RATE", 1.0)
    before = {k: v.copy() for k, v in w.items()}
    seen = {k: np.full_like(v, 1e12) for k, v in w.items()}  # steps are the gradient / 1e6
    met = {k: np.zeros(len(v), np.int64) for k, v in w.items()}
    lm.train_step(w, seen, met, around, target, noise)
    assert met["embed"].sum() == around.size and met["out"].sum() == 21 and met["hidden"].min() == 12
    for k, at in (("out", (int(target[0]), 3)), ("out", (int(noise[0]), lm.HIDDEN)), ("hidden", (5, 7)), ("embed", (int(around[0, 0]), 2)), ("bias", (0, 4))):
        up = {n: v.copy() for n, v in before.items()}
        up[k][at] += 1e-5
        slope = (loss(up) - loss(before)) / 1e-5
        assert abs((before[k][at] - w[k][at]) * 1e6 - slope) < 1e-4


def test_counts_are_those_of_the_corpus(documents):
    rng = random.Random(1)
    texts = [" ".join(chain(rng, 50)) + f" own{i} once" for i in range(20)]
    words = lm.vocabulary(documents([(i, t, "en", "a") for i, t in enumerate(texts)]), size=40, counted=50)
    assert words.total == sum(len(t.split()) for t in texts) and len(words.hashes) == 50 and words.size == 40 and abs(words.share.sum() - 1) < 1e-9
    assert words.counts.count() == len({w for t in texts for w in t.split()})
    assert words.quantiles(np.array([0.0, 0.999999])).tolist()[0] == 0


def test_scores_do_not_depend_on_partitions_and_know_what_occurs_twice(documents):
    rng = random.Random(3)
    texts = [prose(rng, 120, 2_000) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(10)]
    docs = documents(rows)
    one = {r.doc_id: r.log_likelihood for r in lm.score_by_own_words(docs.coalesce(1)).collect()}
    eight = {r.doc_id: r.log_likelihood for r in lm.score_by_own_words(docs.repartition(8)).collect()}
    assert one == eight
    means = {i: one[i] / len(t.split()) for i, t in rows}
    assert min(means[i] for i in range(10)) > np.mean([means[i] for i in range(10, 60)])


@pytest.mark.parametrize("counted", [0, 2, 100])
def test_words_beyond_the_vocabulary_have_counts_of_their_own(documents, counted):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "a b e f")]
    docs = documents(rows)
    words = lm.vocabulary(docs, size=0, counted=counted)
    numbers = lm.numbered(docs, words)
    flat = lm.fresh(len(words.share))  # out is zero: the counts alone
    found = {r.doc_id: r.log_likelihood for r in lm.score(numbers, words, flat).collect()}
    assert abs(found[1] - np.log(np.array([3, 3, 2, 2]) / 12).sum()) < 1e-6 and abs(found[3] - np.log(np.array([3, 3, 1, 1]) / 12).sum()) < 1e-6
    unseen = lm.score(lm.numbered(documents([(9, "zzz")]), words), words, flat).first()
    assert abs(unseen.log_likelihood - np.log(lm.UNSEEN / 12)) < 1e-6


def test_awkward_rows_and_no_rows(documents, awkward):
    out = lm.score_by_own_words(documents(awkward)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(awkward) and by[1].n_tokens == 0 and by[1].log_likelihood == 0 and by[1].mean_log_likelihood is None and by[3].n_tokens == 0
    assert by[7].n_tokens == 60_000 and by[5].log_likelihood < 0
    assert lm.score_by_own_words(documents([])).count() == 0
