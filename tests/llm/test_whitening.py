"""Whitening against the eigenvectors of the full covariance."""

import math

import numpy as np
import pytest

from shelfwise.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, n int, x string, whitened string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], SCHEMA).repartition(parts)


def plain(vectors):
    """x, n x - S squared and summed, eigenvalues and whitened rows up to signs."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = x - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return deviation, e, centred @ u


def check(rows, vectors, components, limit=1e-8):
    deviation, e, projected = plain(vectors)
    ids = sorted({r["vec_id"] for r in rows})
    assert len(rows) == len(vectors) * components and ids == list(range(len(vectors)))
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for k in range(components):
        mine = np.array([got[i, k + 1]["whitened"] for i in ids])
        want = projected[:, k] / math.sqrt(e[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < limit
        assert all(abs(got[i, k + 1]["explained"] - e[k] / e.sum()) < 1e-9 for i in ids)
    assert all(got[i, 1]["deviation"] == deviation[i] and got[i, 1]["n"] == len(vectors) for i in ids)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8


@pytest.mark.parametrize("seed, n, width", [(0, 300, 20), (1, 50, 3), (2, 9, 12), (3, 2000, 40)])
def test_random(spark, seed, n, width):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((n, width)) * np.linspace(3, 0.2, width)).astype(np.float32)
    rows = w.whiten(table(spark, list(enumerate(vectors.tolist())))).collect()
    check(rows, vectors, min(8, width, n - 1))


def test_hot_vector(spark):
    """A third of all rows are one vector, weighed each."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((600, 10)).astype(np.float32)
    vectors[::3] = vectors[0]
    check(w.whiten(table(spark, list(enumerate(vectors.tolist())), 7)).collect(), vectors, 8)


def test_unusable_rows(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((100, 9)).astype(np.float32)
    rows = list(enumerate(vectors.tolist()))
    bad = [(1000, None), (1001, [None] + [0.0] * 8), (1002, [float("nan")] * 9), (1003, [float("inf")] + [0.0] * 8), (1004, [1.0, 2.0]), (1005, [])]
    check(w.whiten(table(spark, rows + bad)).collect(), vectors, 8)


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    rows = [(None if k % 2 else 4, v) for k, v in enumerate(rng.standard_normal((30, 4)).tolist())]
    out = w.whiten(table(spark, rows)).collect()
    assert sum(r["vec_id"] is None for r in out) == 60 and len(out) == 120


def test_no_variance(spark):
    assert w.whiten(table(spark, [])).count() == 0
    assert w.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert w.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    assert w.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    line = w.whiten(table(spark, [(k, [float(k), 1.0]) for k in range(5)])).collect()  # one direction alone varies
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1.0)


def test_huge_entries(spark):
    """Held at 2^40; a deviation beyond a long is null."""
    rows = [(0, [1e38, 0.0]), (1, [-1e38, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 3.0])]
    out = w.whiten(table(spark, rows)).collect()
    assert len(out) >= 4 and {r["vec_id"] for r in out if r["deviation"] is None} == {0, 1}


def plain_step(x):
    calls = []

    def step(c, earlier):
        calls.append(1)
        p = x @ c
        return p @ x, p @ (x @ earlier), float(p @ p)

    return step, calls


@pytest.mark.parametrize("values", [
    np.linspace(9, 1, 30), np.array([5.0] * 12 + [1.0] * 18), np.array([5.0, 5, 5] + [4.0] * 7 + [0.0] * 20),
    np.array([1e5, 1e4, 1e3] + [1.0] * 27), np.zeros(30), np.concatenate(([3.0] * 9, np.linspace(2, 1e-3, 21))),
])
def test_spectra(values):
    """Equal, missing and very unequal singular values: all directions are found."""
    rng = np.random.default_rng(0)
    u, v = (np.linalg.qr(rng.standard_normal((n, 30)))[0] for n in (80, 30))
    x = (u * values) @ v.T
    s, right = w.bidiagonalise(plain_step(x)[0], 30, 8)
    want = np.linalg.svd(x, compute_uv=False)[:8]
    assert len(s) == sum(want > 1e-10 * max(1e-300, values.max()))
    assert np.allclose(s, want[:len(s)], rtol=1e-9)
    assert np.allclose(right @ right.T, np.eye(len(s)), atol=1e-10)
    assert np.allclose(np.linalg.norm(right @ x.T, axis=1), s, rtol=1e-7)


def test_stops_before_the_width():
    """Clear leading values take fewer passes than the space has dimensions."""
    rng = np.random.default_rng(0)
    values = np.concatenate((np.linspace(100, 50, 8), np.linspace(1, 0.5, 292)))
    v = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    step, calls = plain_step(values[:, None] * v.T)
    s, _ = w.bidiagonalise(step, 300, 8)
    assert np.allclose(s, values[:8], rtol=1e-10) and len(calls) < 100
