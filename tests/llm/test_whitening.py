"""Whitening against exact sums and a dense decomposition."""

import math

import numpy as np
import pytest

from stratascan.llm import whitening as w

VEC = "vec_id long, embedding array<float>, label int, index long, x array<long>, white double"


def op11(spark, tmp_path, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    df = spark.createDataFrame([(i, v, 0, 5, None, 1.0) for i, v in zip(ids, vectors, strict=True)], VEC)
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return w.op11_whitening(spark, str(tmp_path)).collect()


def check(got, vectors, ids=None):
    """Against whole numbers without rounding and numpy's decomposition."""
    ids = list(range(len(vectors))) if ids is None else ids
    x = [[math.floor(float(np.float32(c)) * 1024) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(r[i] for r in x) for i in range(d)]
    y = np.array([[(n * c - s) / n for c, s in zip(r, total, strict=True)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, d)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(k):
        want = y @ u[:, j] / np.sqrt(e[j])
        own = np.array([by[i, j + 1].whitened for i in ids])
        assert np.allclose(own, want, atol=1e-7) or np.allclose(own, -want, atol=1e-7)
        assert by[ids[0], j + 1].explained == pytest.approx(e[j] / e.sum(), rel=1e-9)
    for i, r in zip(ids, x, strict=True):
        assert by[i, 1].deviation == sum((n * c - s) ** 2 for c, s in zip(r, total, strict=True))
    assert {r.identity_error for r in got}.pop() < 1e-9


@pytest.mark.parametrize("n, d", [(500, 12), (40, 3)])
def test_equals_a_dense_decomposition(spark, tmp_path, monkeypatch, n, d):
    monkeypatch.setattr(w, "BLOCK_BYTES", 8 * d * 16)  # many blocks
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, d)) * np.arange(1, d + 1) / 5 + 0.3).astype(np.float32).tolist()
    check(op11(spark, tmp_path, vectors), vectors)


def test_vectors_that_take_no_part(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((30, 4)) * np.arange(1, 5)).astype(np.float32).tolist()
    odd = [None, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [], [3e38, 0.0, 0.0, 0.0]]
    check(op11(spark, tmp_path, vectors + odd), vectors)


def test_ids_that_are_null_or_repeat(spark, tmp_path):
    rng = np.random.default_rng(4)
    got = op11(spark, tmp_path, rng.standard_normal((10, 3)).tolist(), [None, None, 1, 1, *range(2, 8)])
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in got if r.component == 1) == [-1, -1, 1, 1, *range(2, 8)]


def test_components_without_variance(spark, tmp_path):
    vectors = [[float(i), 1.0, 2.0 * i] for i in range(20)]
    got = op11(spark, tmp_path, vectors)
    assert len(got) == 60
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {r.identity_error < 1e-9 for r in got} == {True}


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_equal_vectors_only(spark, tmp_path, vectors):
    got = op11(spark, tmp_path, vectors)
    assert len(got) == 2 * len(vectors)
    assert all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in got)


@pytest.mark.parametrize("vectors", [[], [None, []]])
def test_no_vectors(spark, tmp_path, vectors):
    assert op11(spark, tmp_path, vectors) == []


def test_deviations_that_just_fit():
    edge = math.isqrt(2**63 - 1)
    y = np.array([[edge, 0], [edge + 1, 0], [edge, edge], [3, 4], [-(2**62), 0]], np.int64)
    assert w.deviations(y) == [edge**2, None, None, 25, None]


def test_whole_numbers_wrap_back():
    x = np.array([[2**40 + 5], [2**40 - 5]], np.int64)
    n = 2**30
    assert w.scaled(x, n, [n * 2**40]).ravel().tolist() == [5 * n, -5 * n]
