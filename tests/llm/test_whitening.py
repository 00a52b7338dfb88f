import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.llm.queries import op12_embedding_whitening
from lattice.llm.whitening import jacobi, whitened_rows, whole_vectors

BAD = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [1.0, float("inf"), 2.0], [1.0, 2.0], [1.0, 2.0, float("-inf")]]


def brute(vectors, top=16):
    """By numpy's own eigensolver, from Python integers."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), object)
    n, sums = len(fit), fit.sum(axis=0)
    y = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    cov = y.T @ y / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(top, len(values))
    z = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x]) @ basis[:, :k] / np.sqrt(values[:k])
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, z, values[:k] / np.trace(cov)


def compare(got, ids, vectors):
    n, deviation, z, explained = brute(vectors)
    k = z.shape[1]
    assert len(got) == len(ids) * k
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, []).append(r)
    signs = np.ones(k)
    for at, i in enumerate(ids):
        mine = sorted(rows[i], key=lambda r: r.component)[:: len(rows[i]) // k]
        assert [r.component for r in mine] == list(range(1, k + 1)) and {r.n for r in mine} == {n} and {r.deviation for r in mine} == {deviation[at]}
        values = np.array([r.whitened for r in mine])
        if not at:
            signs = np.sign(values * z[0])
        assert np.allclose(values * signs, z[at], atol=1e-6) and np.allclose([r.explained for r in mine], explained, rtol=1e-9)
        assert all(r.identity_error <= 1e-10 for r in mine)


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_jacobi_diagonalises(d):
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = 10.0 ** -np.linspace(0, 9, d)
    m = (basis * values) @ basis.T
    got, vectors = jacobi(m)
    assert np.allclose(got, values, rtol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and np.allclose((vectors * got) @ vectors.T, m, atol=1e-14)


def test_jacobi_keeps_small_eigenvalues_accurate():
    """A scaled matrix whose eigenvalues span 24 powers of ten: each comes out to full relative accuracy."""
    scale = np.diag(10.0 ** -np.arange(0, 13, 4))
    core = np.array([[1, 0.1, 0.2, 0.05], [0.1, 1, 0.1, 0.2], [0.2, 0.1, 1, 0.1], [0.05, 0.2, 0.1, 1]])
    values, _ = jacobi(scale @ core @ scale)
    # the product of the eigenvalues is the determinant, which the smallest one carries as much as the largest
    assert np.prod(values) == pytest.approx(np.linalg.det(core) * np.prod(np.diag(scale)) ** 2, rel=1e-12)
    assert (values > 0).all() and np.array_equal(jacobi(np.zeros((3, 3)))[0], np.zeros(3))


def test_rows_equal_brute_force(spark):
    rng = random.Random(12)
    for d in (3, 20):
        vectors = [[rng.gauss(0.3, 1 + k) for k in range(d)] for _ in range(200)]
        vectors += [vectors[0]] * 300  # a hot vector counts once
        rows = [(k, v, "e", 1) for k, v in enumerate(vectors)] + [(1000 + k, v, None, 2) for k, v in enumerate(BAD)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, component int").repartition(5)
        compare(whitened_rows(table).collect(), range(len(vectors)), vectors)


def test_defined_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert whitened_rows(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitened_rows(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0])], schema)).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.identity_error is None for r in one)
    flat = whitened_rows(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and all(r.identity_error < 1e-12 for r in flat)
    huge = whitened_rows(spark.createDataFrame([(1, [1e300, 0.0]), (2, [1e16, 0.0]), (3, [-1e16, 4.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in huge} == {2, 3, 4} and all(r.deviation is None for r in huge if r.vec_id < 4)
    ties = whole_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [-0.01, 0.0]), (4, [0.5])], schema)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.x) for r in ties] == [(1, [1_000_064]), (4, [1_000_032])]
    wide = spark.createDataFrame([(k, [float(k) * 2**20, float(k * k)]) for k in range(200)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitened_rows(wide).where("component = 1").collect()}
    _, deviation, _, _ = brute([[float(k) * 2**20, float(k * k)] for k in range(200)])
    assert [got[k] for k in range(200)] == [w if w < 2**63 else None for w in deviation] and None in got.values()


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(op12_embedding_whitening(spark, sf_dir).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
    assert op12_embedding_whitening(spark, sf_dir).agg(F.max("component")).first()[0] == 16
