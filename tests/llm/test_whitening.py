"""Operator 13 against a plain solver and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest
from compare import DATA

from siltstone.llm import whitening as W


def random_rotation(d, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


@pytest.mark.parametrize("values", [np.arange(12, 0, -1.0), np.geomspace(1, 1e-9, 12), np.array([3, 3, 3, 1, 1, 1e-3, 1e-3, 1e-3, 0, 0, 0, 0.0]), np.array([1 + 1e-10, 1, 1 - 1e-10, 0.5, 0.5 + 1e-9, 0.25, 0.2, 0.1, 0.1 + 1e-12, 0.05, 0.01, 0])])
def test_eigenvectors_of_plain_and_clustered_spectra(values):
    q = random_rotation(12, 7)
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, u = W.eigenvectors(v)
    assert np.allclose(e, np.sort(values)[::-1], atol=1e-14)
    assert np.abs(u.T @ u - np.eye(12)).max() < 1e-14
    assert np.abs(v @ u - u * e).max() < 1e-14


def test_steps_gain_digits_over_float32():
    q = random_rotation(40, 1)
    v = (q * np.arange(1, 41.0)) @ q.T
    a = ((v + v.T) / 2).astype(W.WIDE)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(W.WIDE)
    rest = lambda x: float(np.abs(a @ x - x * np.diag(x.T @ (a @ x))).max())
    first, once = rest(x), rest(W.refine(a, x)[0])
    assert once < 1e-3 * first and rest(W.refine(a, W.refine(a, x)[0])[0]) < 1e-14


def test_zero_and_single_matrices():
    assert W.eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert W.eigenvectors(np.array([[4.0]]))[0].tolist() == [4]


def brute(rows):
    """By dimension: n, exact sums, covariance in fractions of the distinct floors."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for _, x in kept} - {0}:
        fit = sorted({tuple(x) for _, x in kept if len(x) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        dev = [[n * c - t for c, t in zip(x, s)] for x in fit]
        cov = np.array([[float(Fraction(sum(x[i] * x[j] for x in dev), n**3)) for j in range(d)] for i in range(d)])
        out[d] = (n, s, cov)
    return kept, out


def compare(got, rows, most=4):
    kept, models = brute(rows)
    want = sum(min(most, len(x)) for _, x in kept)
    assert len(got) == want
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in kept:
        d = len(x)
        if not d:
            continue
        n, s, cov = models[d]
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1], u[:, ::-1]
        deviation = sum((n * c - t) ** 2 for c, t in zip(x, s))
        for k in range(min(most, d)):
            options = [r for r in by[i, k + 1] if r.deviation == (deviation if deviation < 1 << 63 else None)]
            assert options and options[0].n == n
            r = options[0]
            if r.whitened is None:
                assert e[k] <= 1e-9 * np.trace(cov) or not np.trace(cov)
                continue
            assert abs(r.explained - e[k] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-9
            w = float((np.array(x) - np.array(s) / n) @ u[:, k] / np.sqrt(e[k]))
            if abs(w) > 1e-3:
                sign = signs.setdefault((d, k), np.sign(w * r.whitened))
                assert abs(w - sign * r.whitened) < 1e-6 * max(1, abs(w))


def test_query_is_the_plain_solvers(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    compare(W.op13_whitening(spark, DATA).collect(), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [nan, 1.0, 2.0]), (103, [inf, 1.0, 2.0]), (104, [None, 1.0, 2.0]), (None, [0.5, 0.25, 0.125]), (3, rows[3][1]), (3, [1.0, 2.0, 3.0]), (200, [0.1, 0.2]), (201, [0.3, -0.2]), (202, [0.3, 0.9]), (300, [-0.001] * 5)]
    df = spark.createDataFrame([(i, v, "x", 0.0, 1) for i, v in rows], "vec_id long, embedding array<double>, id string, x double, n int").repartition(3)
    got = W.whitened(df).collect()
    assert {r.vec_id for r in got} == {*range(40), None, 200, 201, 202, 300}
    assert [r.whitened for r in got if r.vec_id == 300] == [None] * 4 and {r.component for r in got if r.vec_id == 200} == {1, 2}
    compare(got, rows)
    none = W.whitened(df.limit(0))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not none.count()


def test_huge_entries_keep_exact_deviations(spark):
    rows = [(i, [float(3e15 * (i % 7)), float(i), -float(2e15 * (i % 3))]) for i in range(30)]
    compare(W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect(), rows)
