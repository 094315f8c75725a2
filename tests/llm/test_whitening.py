"""Whitening against exact integers and a dense decomposition."""

import numpy as np
import pytest

from assay.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def want(vectors):
    """n, deviations, covariance spectrum (falling) and vectors, by plain integers and a dense solver."""
    x = [[int(np.floor(1024.0 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    a = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in x])
    values, components = np.linalg.eigh(a.T @ a / n)
    return n, deviations, a, values[::-1], components[:, ::-1]


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def test_components_equal_a_dense_solver(spark):
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(300, 12)) @ np.diag(np.geomspace(3, 0.02, 12)) @ r.normal(size=(12, 12))).astype(np.float32).tolist()
    n, deviations, a, values, components = want(vectors)
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == 300 * 8 and {row.component for row in rows} == set(range(1, 9)) and {row.n for row in rows} == {n}
    assert len({row.identity_error for row in rows}) == 1 and rows[0].identity_error < 1e-9
    got = np.zeros((300, 8))
    for row in rows:
        assert row.deviation == deviations[row.vec_id]
        assert row.explained == pytest.approx(values[row.component - 1] / values.sum(), rel=1e-9)
        got[row.vec_id, row.component - 1] = row.whitened
    expected = a @ components[:, :8] / np.sqrt(values[:8])
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * signs).max() < 1e-7


def test_ill_conditioned_rows_keep_their_small_components(spark):
    r = np.random.default_rng(8)
    basis = np.linalg.qr(r.normal(size=(6, 6)))[0]
    rows = (r.normal(size=(400, 6)) * [1e6, 1e5, 1e3, 30, 1, 0.1]) @ basis
    vectors = rows.astype(np.float32).tolist()
    _, _, a, _, _ = want(vectors)
    singular = np.linalg.svd(a, compute_uv=False)
    model = whitening.fit(frame(spark, vectors))
    assert np.allclose(np.sqrt(model.variances * model.n), singular, rtol=1e-7)
    assert np.abs(model.components.T @ model.components - np.eye(6)).max() < 1e-13
    assert whitening.identity_error(frame(spark, vectors), model) < 1e-6


def test_directions_without_variance_are_null(spark):
    vectors = [[float(i), float(i), 7.0, float(i % 3)] for i in range(50)]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    by = {c: [row for row in rows if row.component == c] for c in range(1, 5)}
    assert all(row.whitened is not None for c in (1, 2) for row in by[c]) and all(row.whitened is None and row.explained == 0 for c in (3, 4) for row in by[c])
    assert rows[0].identity_error < 1e-9


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, 2.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0], [3.0, 1.0], [3.0, 1.0], [0.0, -5.0]]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 9, 9]
    rows = whitening.whiten(frame(spark, vectors, ids)).collect()
    assert sorted((row.vec_id is None, row.vec_id or 0, row.component) for row in rows) == sorted((i is None, i or 0, c) for i in (3, None, 9, 9) for c in (1, 2))
    same = want([[1.0, 2.0], [3.0, 1.0], [3.0, 1.0], [0.0, -5.0]])
    assert sorted(row.deviation for row in rows if row.component == 1) == sorted(same[1])
    assert whitening.whiten(frame(spark, [None, [None]])).collect() == []
    one = whitening.whiten(frame(spark, [[1.0, 2.0]])).collect()
    assert [(row.n, row.deviation, row.whitened, row.explained, row.identity_error) for row in one] == [(1, 0, None, None, None)] * 2
    extra = frame(spark, [[1.0], [2.0]]).selectExpr("*", "1 AS n", "2 AS component", "3 AS whitened")
    assert {(row.vec_id, round(abs(row.whitened), 9)) for row in whitening.whiten(extra).collect()} == {(0, 1.0), (1, 1.0)}


def test_large_entries_stay_exact(spark):
    vectors = [[3e12, 1.0], [-2e12, 4.0], [1e38, 0.0]]
    rows = {row.vec_id: row for row in whitening.whiten(frame(spark, vectors)).collect() if row.component == 1}
    assert all(row.deviation is None for row in rows.values()) and rows[0].n == 3
    small = [[3000.0, 1.0], [-2000.0, 4.0]]
    assert sorted({row.deviation for row in whitening.whiten(frame(spark, small)).collect()}) == sorted(set(want(small)[1]))


def test_query_equals_the_dense_solver_on_its_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    source = {row.vec_id: row.embedding for row in table.collect()}
    ids = sorted(source)
    n, deviations, a, values, components = want([source[i] for i in ids])
    got = np.zeros((n, 8))
    at = {i: k for k, i in enumerate(ids)}
    for row in whitening.op12_whitening(spark, "/root/testdata/sf0.001").collect():
        got[at[row.vec_id], row.component - 1] = row.whitened
        assert row.deviation == deviations[at[row.vec_id]] and row.identity_error < 1e-9 and abs(row.explained - values[row.component - 1] / values.sum()) < 1e-9
    expected = a @ components[:, :8] / np.sqrt(values[:8])
    assert np.abs(np.abs(got) - np.abs(expected)).max() < 1e-6
