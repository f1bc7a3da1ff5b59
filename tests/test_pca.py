"""Sparse principal components against a dense decomposition."""

import numpy as np
import pytest

from introna.operators.pca import sparse_principal_components


def decompose(spark, dense, k, **more):
    n, d = dense.shape
    rows = [(i, f"f{j:03d}", float(dense[i, j])) for i in range(n) for j in range(d) if dense[i, j]]
    x = spark.createDataFrame(rows, "cell_id long, gene string, value double").repartition(3)
    cells = spark.createDataFrame([(i,) for i in range(n)], "cell_id long")
    scores, loadings, variances = sparse_principal_components(x, "gene", cells, k, **more)
    s = np.array([r["pc"] for r in sorted(scores.collect())])
    v = {r["gene"]: r["loading"] for r in loadings.collect()}
    return s, np.array([v.get(f"f{j:03d}", [0.0] * s.shape[1]) for j in range(d)]), variances


@pytest.mark.parametrize(("n", "d", "k"), [(120, 40, 4), (30, 60, 3), (50, 5, 5)])
def test_components_equal_the_dense_ones(spark, n, d, k):
    rng = np.random.default_rng(n)
    dense = (rng.normal(size=(n, 6)) * [9, 7, 5, 3, 2, 1.5]) @ rng.normal(size=(6, d)) + rng.normal(size=(n, d)) * 0.3 + 4
    dense[rng.random((n, d)) < 0.5] = 0
    dense[3] = 0  # a cell without entries
    s, v, variances = decompose(spark, dense, k)
    centred = dense - dense.mean(axis=0)
    u, sizes, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(variances, (sizes**2 / (n - 1))[:k], rtol=1e-8)
    for i in range(k):
        sign = np.sign(axes[i][np.abs(axes[i]).argmax()])
        assert np.allclose(v[:, i], sign * axes[i], atol=1e-5)
        assert np.allclose(s[:, i], sign * u[:, i] * sizes[i], atol=1e-4 * sizes[0])
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-7)


def test_components_of_little(spark):
    s, v, variances = decompose(spark, np.outer(np.arange(1.0, 8.0), [1.0, 2.0, 0.0]), 3)
    assert len(variances) == 1 and variances[0] == pytest.approx(np.arange(1, 8).var(ddof=1) * 5)
    assert np.allclose(np.abs(v[:, 0]), np.array([1, 2, 0]) / 5**0.5)
    s, v, variances = decompose(spark, np.zeros((4, 2)), 2)
    assert s.shape == (4, 0) and variances == []
