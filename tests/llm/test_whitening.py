import math

import numpy as np
import pytest

from quillstream.llm import whitening

ROWS = "vec_id long, embedding array<double>, label int, n string, whitened string"


def table(spark, rows, kind=ROWS):
    return spark.createDataFrame([(r[0], r[1], 0, "n", "w") for r in rows], kind)


def brute(rows):
    """By the full covariance matrix: ids, x, deviation, components by falling eigenvalue, whitened, explained."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = [[math.floor(1024 * float(v)) + 100_000 for v in r[1]] for r in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    c = np.array([[(n * v - s) / n for v, s in zip(r, sums)] for r in x])
    e, q = np.linalg.eigh(c.T @ c / n)
    return [r[0] for r in kept], n, deviation, e[::-1], q[:, ::-1], c


def check(spark, rows, k=8, **how):
    ids, n, deviation, e, q, c = brute(rows)
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    out = whitening.whiten(table(spark, rows), **how).collect()
    assert len(out) == len(ids) * k
    got = {}
    for r in out:
        got.setdefault(r.component, {})[r.vec_id] = r
    want = c @ q[:, :k] / np.sqrt(e[:k])
    for j in range(k):
        mine = np.array([got[j + 1][i].whitened for i in ids])
        assert np.abs(mine - want[:, j] * np.sign(mine @ want[:, j])).max() < 1e-8
        for i, d in zip(ids, deviation):
            r = got[j + 1][i]
            assert (r.n, r.deviation) == (n, d) and r.explained == pytest.approx(e[j] / e.sum(), rel=1e-10) and r.identity_error < 1e-10


def test_matches_the_full_covariance(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 40)) * np.linspace(1, 1.2, 40))]
    check(spark, rows)


def test_nulls_and_entries_that_are_not_finite_drop_the_row(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 5)))]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [1.0, math.nan, 1.0, 1.0, 1.0]), (103, [math.inf, 0.0, 1.0, 1.0, 1.0]), (104, [-math.inf, 0.0, 1.0, 1.0, 1.0])]
    check(spark, rows)
    out = whitening.whiten(table(spark, [*rows, (105, []), (106, [1.0]), (107, [1e300] * 5), (None, rows[0][1])])).collect()
    assert {r.vec_id for r in out} == {*range(60), None}


def test_rows_that_repeat_and_flat_clouds(spark):
    rows = [(7, [1.0, 2.0, 3.0])] * 30 + [(8, [1.5, 2.0, 3.0])] * 3 + [(9, [1.0, 2.5, 3.0])]
    out = whitening.whiten(table(spark, rows)).collect()
    assert len(out) == 34 * 2 and max(r.component for r in out) == 2 and out[0].identity_error < 1e-10
    for empty in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        found = whitening.whiten(table(spark, empty))
        assert found.count() == 0 and found.columns[0] == "vec_id"


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [v, -v]) for i, v in enumerate([2.0**42, 1.0, -(2.0**41), 0.5])]
    out = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    _, _, deviation, *_ = brute(rows)
    assert [out[i] for i in range(4)] == [d if d < 2**63 else None for d in deviation]


@pytest.mark.parametrize("dims,width,kept", [(300, 6, 4), (300, 16, 8), (50, 4, 3), (7, 16, 8), (1, 2, 2)])
def test_iteration_certifies_every_component(dims, width, kept):
    """Slowly falling eigenvalues, with a tie inside: restarts included, against the dense solver."""
    rng = np.random.default_rng(dims)
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    e = np.sort(1 + rng.random(dims) ** 3)[::-1] * 100
    if dims > 5:
        e[3] = e[2]
    matrix = (turn * e) @ turn.T
    passes = []
    values, vectors, n, residual = whitening.subspace(lambda q: passes.append(q.shape) or matrix @ q, dims, 4, width, kept)
    k = min(4, dims)
    assert n == len(passes) and all(s[1] <= max(width, 1) for s in passes) and residual < 1e-12
    assert np.allclose(values, e[:k], rtol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-9
    if dims == 300:
        assert sum(s[1] for s in passes) > width * kept, "a restart is part of the test"
