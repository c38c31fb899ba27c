"""Whitening against dense linear algebra, and the exact parts against plain arithmetic."""

from __future__ import annotations

import math
from decimal import localcontext
from fractions import Fraction

import numpy as np
import pytest

from devpulse.llm import embedding_whitening, exact_eigen

from odd_documents import rows


def plain_polynomial(matrix):
    """det(xI - matrix) by the method of Faddeev and LeVerrier in fractions."""
    n = len(matrix)
    a = np.array([[Fraction(x) for x in row] for row in matrix], dtype=object)
    m, c, out = np.zeros((n, n), dtype=object), Fraction(1), [1]
    eye = np.array([[Fraction(i == j) for j in range(n)] for i in range(n)], dtype=object)
    for k in range(1, n + 1):
        m = a.dot(m) + c * eye
        c = -sum(a.dot(m)[i, i] for i in range(n)) / k
        out.append(int(c))
    return out


def gram(seed, n, rank, scale):
    rng = np.random.default_rng(seed)
    x = rng.integers(-scale, scale + 1, size=(rank, n)).astype(object)
    return x.T.dot(x).tolist()


@pytest.mark.parametrize("n, rank, scale", [(1, 3, 5), (2, 2, 9), (7, 20, 10**6), (12, 5, 1000), (9, 30, 10**12)])
def test_characteristic_polynomial(spark, n, rank, scale):
    matrix = gram(n + rank, n, rank, scale)
    assert exact_eigen.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)


def test_zero_pivots(spark):
    """Sparse matrices need exchanges of rows, or columns with nothing to remove."""
    for matrix in ([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 4, 0], [1, 0, 0, 5]], [[3 * (i == j) for j in range(6)] for i in range(6)], [[1] * 5] * 5):
        assert exact_eigen.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)


def test_roots_with_multiplicity(spark):
    diagonal = [9, 4, 4, 4, 1, 0, 0]
    roots = exact_eigen.RealRoots(exact_eigen.characteristic_polynomial(spark, [[d * (i == j) for j in range(7)] for i, d in enumerate(diagonal)]))
    assert [roots.above(x) for x in (-1, 0, 1, 3, 4, 8, 9)] == [7, 5, 4, 4, 1, 1, 0]
    for k, d in enumerate(diagonal[:5], 1):
        a, bits = roots.largest(k, 22)
        assert Fraction(a - 1, 2**bits) < d <= Fraction(a, 2**bits) and a.bit_length() >= exact_eigen.ROOT_BITS


@pytest.mark.parametrize("diagonal", [[5, 5, 5, 2], [10**9, 10**9 - 1, 3, 3], [10**14, 1, 0, 0], [7, 0, 0, 0]])
def test_equal_near_and_zero_eigenvalues(spark, diagonal):
    q = [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]  # orthogonal rows of length 2
    matrix = [[sum(d * q[k][i] * q[k][j] for k, d in enumerate(diagonal)) for j in range(4)] for i in range(4)]
    found = exact_eigen.leading(spark, matrix, 4)
    assert [float(c.value) for c in found] == pytest.approx([4.0 * d for d in diagonal if d], rel=1e-15)
    v = np.array([[float(x) for x in c.vector] for c in found])
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-15
    with localcontext(prec=exact_eigen.DIGITS):
        for c in found:
            image = [sum(matrix[i][j] * c.vector[j] for j in range(4)) - c.value * c.vector[i] for i in range(4)]
            assert max(abs(x) for x in image) <= c.value / 2**70


def plain(vectors, most=4):
    x = np.array(vectors, dtype=object)
    distinct = np.unique(x.astype(np.int64), axis=0).astype(object)
    n, s = len(distinct), distinct.sum(axis=0)
    centred = (distinct - s / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:most]
    w = (x - s / n).astype(float) @ v[:, order] / np.sqrt(np.maximum(e[order], 1e-300))
    return n, [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x], w, e[order] / e.sum()


def test_equals_dense_algebra(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 12)) * np.linspace(2, 0.3, 12)).astype(np.float32)
    x[100:200] = x[0]  # a hot vector
    table = spark.createDataFrame([(i, v.tolist(), "x", 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n string, whitened double")
    found = embedding_whitening.whiten(table.repartition(6)).orderBy("component", "vec_id").toPandas()
    n, deviation, w, explained = plain(np.floor(256 * x.astype(np.float64)).astype(np.int64).tolist())
    assert set(found.n) == {n} == {300}
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-12
    for k in range(4):
        part = found[found.component == k + 1]
        assert [int(d) for d in part.deviation] == deviation
        assert min(np.abs(part.whitened - sign * w[:, k]).max() for sign in (1, -1)) < 1e-9
        assert part.explained.nunique() == 1 and part.explained.iloc[0] == pytest.approx(explained[k], rel=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-0.0, 0.001]), (None, [3.0, -1.0]), (4, [5.0])]
    dropped = [(5, None), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [1.0, -inf])]
    table = spark.createDataFrame([(*v, 0) for v in vectors + dropped], "vec_id long, embedding array<float>, component int")
    found = embedding_whitening.whiten(table).collect()
    n, deviation, w, _ = plain([[256, 0], [256, 0], [0, 512], [0, 0], [768, -256], [1280, 0]])
    assert sorted(str(r.vec_id) for r in found) == sorted(str(i) for i, _ in vectors for _ in range(2))
    first = sorted((str(r.vec_id), int(r.deviation), round(abs(r.whitened), 9)) for r in found if r.component == 1)
    assert first == sorted((str(i), d, round(abs(x), 9)) for (i, _), d, x in zip(vectors, deviation, w[:, 0]))
    assert {r.n for r in found} == {n}


def test_huge_entries_stay_exact(spark):
    big = 1e30
    vectors = [[big, 1.0], [-big, 2.0], [1.0, 3.0], [2e15, -7.0]]
    found = embedding_whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    rows_ = found.where("component = 1").orderBy("vec_id").collect()
    limit = 2**63
    whole = [[limit - 1, 256], [-limit, 512], [256, 768], [int(256 * 2e15), -7 * 256]]
    s = [sum(c) for c in zip(*whole)]
    wanted = [sum((4 * a - b) ** 2 for a, b in zip(r, s)) for r in whole]
    assert [None if r.deviation is None else int(r.deviation) for r in rows_] == [d if d < 10**38 else None for d in wanted]
    assert all(math.isfinite(r.whitened) for r in rows_) and rows_[0].identity_error < 1e-9


def test_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = embedding_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))
    assert rows(one) == sorted([(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)], key=lambda r: [str(v) for v in r])
    flat = embedding_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [2.0, 2.0, 0.0])], schema)).collect()
    assert {(r.component, r.explained, r.whitened is None) for r in flat} == {(1, 1.0, False), (2, 0.0, True), (3, 0.0, True)}
    for empty in ([], [(1, None)], [(1, [])]):
        none = embedding_whitening.whiten(spark.createDataFrame(empty, schema))
        assert rows(none) == [] and none.columns == one.columns
