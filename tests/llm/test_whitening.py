"""Whitening against numpy's dense eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm.whitening import components, fit_list, quantised, whiten


def frame(spark, rows, k=16):
    return {(r.vec_id, r.component): r for r in whiten(rows, k).collect()}


def expected(vectors):
    x = np.floor(64 * np.asarray(vectors, float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], turn[:, ::-1]


def same_as_numpy(got, vectors, ids, k):
    x, n, sums, values, turn = expected(vectors)
    kept = min(k, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(set(ids)) * kept
    for c in range(kept):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        theirs = ((n * x - sums) / n) @ turn[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7
        row = got[ids[0], c + 1]
        assert abs(row.explained - values[c] / values.sum()) < 1e-9 and row.identity_error < 1e-9 and row.n == n
    for i, row in zip(ids, x):
        assert got[i, 1].deviation == sum(int(n * a - s) ** 2 for a, s in zip(row, sums))


def test_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 40)) * np.linspace(3, 0.5, 40)
    vectors[100:180] = vectors[5]  # copies count once in the fit
    df = spark.createDataFrame([(i, v.tolist(), 9) for i, v in enumerate(vectors)] + [(1000, None, 0), (1001, [None] * 40, 0), (1002, [float("nan")] * 40, 0), (1003, [float("inf")] * 40, 0), (1004, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, n int")
    same_as_numpy(frame(spark, df), vectors, list(range(400)), 16)


def test_fewer_dimensions_than_components(spark):
    vectors = np.random.default_rng(4).normal(size=(30, 5))
    vectors[:, 3] = 1.0  # does not vary
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    same_as_numpy(frame(spark, df), vectors.astype(np.float32).astype(float), list(range(30)), 16)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)], [(1, [])]])
def test_nothing_varies(spark, rows):
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_repeated_rows_stay_and_null_ids(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [5.0, 1.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 2 and {r.n for r in got} == {3}


def test_certificate_on_table(spark, sf_dir):
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    basis = components(fit_list(rows))
    assert basis.residual < 1e-10 and basis.identity_error < 1e-9
    x = np.array([r.x for r in rows.collect()])
    fit = np.unique(x, axis=0)
    centred = (len(fit) * fit - fit.sum(axis=0)) / len(fit)
    values = np.linalg.eigvalsh(centred.T @ centred / len(fit))[::-1]
    assert np.abs(basis.values / values[:16] - 1).max() < 1e-10 and abs(basis.trace / values.sum() - 1) < 1e-10
