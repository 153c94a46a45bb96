"""Whitening against a dense eigendecomposition."""
import math

import numpy as np
import pytest

from strainlens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string"


def dense(vectors, k=4):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(int)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    c = distinct - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ (u / np.sqrt(e)), e / np.trace(c.T @ c / n)


def compare(rows, vectors, k=4):
    n, deviation, white, explained = dense(vectors, k)
    assert len(rows) == k * len(vectors)
    got = np.full((len(vectors), k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-10)
        assert r.identity_error < 1e-9
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-8


def points(n, d, seed):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(1.5, 1, d) + r.standard_normal(d)).astype(np.float32)


@pytest.mark.parametrize("d", [3, 5, 40])
def test_whitened_as_by_dense_decomposition(spark, d):
    x = points(400, d, d)
    x[200:260] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], SCHEMA).repartition(5)
    compare(whitening.whitened(df).collect(), x, min(4, d))


def test_query_on_the_given_table(spark):
    rows = queries.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    table = sorted(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect())
    assert [r.vec_id for r in table] == list(range(len(table)))
    compare(rows, [r.embedding for r in table])


def test_rows_that_do_not_count(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [0.0, 0.0], ""), (1, [1.0, -0.5], ""), (1, [1.0, -0.5], ""), (None, [0.25, 2.0], ""), (3, None, ""), (4, [None, 1.0], ""), (5, [nan, 1.0], ""), (6, [1.0, inf], ""), (7, [], ""), (8, [1.0], "")]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i in (0, 1, 1, None) for c in (1, 2))
    assert {r.n for r in got} == {3} and max(r.identity_error for r in got) < 1e-12
    # 3 x - S for x = (0, 0), S = (256 + 64, -128 + 512)
    assert {r.deviation for r in got if r.vec_id == 0} == {320 ** 2 + 384 ** 2}


@pytest.mark.parametrize("rows", [[], [(1, None, "")], [(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")]])
def test_without_variance_there_are_no_components(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_components_of_no_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 0.5], "") for i in range(20)]
    assert {r.component for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}


def test_values_beyond_a_long(spark):
    rows = [(0, [3e38, 1.0], ""), (1, [-3e38, 2.0], ""), (2, [0.0, 3.0], "")]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2} and {r.deviation for r in got if r.vec_id == 0} == {None}


@pytest.mark.parametrize("gap", [1e-2, 1e-6, 0.0])
def test_flat_spectra_are_certified(gap):
    d = 60
    r = np.random.default_rng(3)
    u = np.linalg.qr(r.standard_normal((d, d)))[0]
    value = 1 + gap * np.arange(d)[::-1]
    v = (u * value) @ u.T
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return v @ block

    got, vectors = whitening.top_eigenpairs(product, d, 4, block=8)
    assert np.allclose(got, value[:4], rtol=1e-12)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert len(passes) < 400


@pytest.mark.parametrize("low", [[], [1.0], [0.0] * 30, [1e-3, 500.0]])
def test_small_values_far_below_the_others_do_no_harm(low):
    value = np.concatenate(([1700, 1660, 1092, 1081], np.linspace(1077, 925, 60), low))
    r = np.random.default_rng(4)
    u = np.linalg.qr(r.standard_normal((len(value), len(value))))[0]
    v = (u * value) @ u.T
    passes = []
    got, vectors = whitening.top_eigenpairs(lambda block: passes.append(1) or v @ block, len(value), 4)
    assert np.allclose(got, value[:4], rtol=1e-12)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-8 and len(passes) < 150
