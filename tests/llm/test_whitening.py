"""Whitening against numpy's symmetric eigensolver and exact integers."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from packetloom.llm import queries as Q
from packetloom.llm import whitening as W

SF = "/root/testdata/sf0.01"


def brute(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    centred = d.astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return (d * d).sum(axis=1).tolist(), centred, e[::-1], v[:, ::-1]


def test_query_against_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = Q.QUERIES["op12_whitening"](spark, SF).toPandas()
    dev, centred, e, v = brute(t["embedding"])
    at = {i: k for k, i in enumerate(t["vec_id"])}
    k = min(32, centred.shape[1])
    assert len(rows) == len(at) * k and set(rows.n) == {len(at)}
    assert (rows.deviation == [dev[at[i]] for i in rows.vec_id]).all()
    want = centred @ v[:, :k] / np.sqrt(e[:k])
    got = np.zeros_like(want)
    got[rows.vec_id.map(at), rows.component - 1] = rows.whitened
    for c in range(k):
        assert min(np.abs(got[:, c] - want[:, c]).max(), np.abs(got[:, c] + want[:, c]).max()) < 1e-7
    assert np.allclose(rows.explained, (e / e.sum())[rows.component - 1], rtol=1e-9)
    error = np.abs(got.T @ got / len(at) - np.eye(k)).max()
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9 and abs(rows.identity_error[0] - error) < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -3.0]), (None, [7.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (7, [1.0]), (8, []), (9, [1e300, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS n", "'y' AS whitened")
    rows = W.whitened(df).collect()
    # Beside the bound of an entry the second direction is within rounding.
    assert sorted((r.vec_id or 0) for r in rows) == [0, 1, 1, 2, 9] and {r.n for r in rows} == {5}
    assert all(r.deviation is None and int(r.deviation_text) > 1 << 63 for r in rows)
    rows = W.whitened(df.where("vec_id IS NULL OR vec_id < 9")).collect()
    assert len(rows) == 8 and max(r.identity_error for r in rows) < 1e-12
    dev = brute([v for _, v in vectors[:4]])[0]
    assert sorted({r.deviation for r in rows}) == sorted(set(dev)) and all(str(r.deviation) == r.deviation_text for r in rows)
    # One direction only; no direction at all; no row.
    line = W.whitened(spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0])], df.select("vec_id", "embedding").schema)).collect()
    assert [(r.vec_id, r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in line] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    assert W.whitened(df.where("vec_id = 1")).count() == 0 and W.whitened(df.limit(0)).count() == 0


def test_small_deviations_are_accurate():
    """Singular values ten decades apart, which a covariance matrix would lose in rounding."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    u, _ = np.linalg.qr(rng.normal(size=(40, 9)))
    sigma = 10.0 ** -np.arange(9)
    v, got = W.jacobi(W.folded(None, u * sigma @ q.T))
    assert np.allclose(got, sigma, rtol=1e-6) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)
    assert np.allclose(np.abs(np.sum(v * q, axis=0)), 1)


@pytest.mark.parametrize("d", [1, 2, 5, 8])
def test_every_pair_meets_once(d):
    met = [(a, b) for p, q in W.pairings(d) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(met) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_factors_fold_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(20)
    rows, dim = W.usable(df, "vec_id", "embedding")
    n, sums = W.exact_sums(rows, dim)
    r = W.triangular(rows, dim, lambda y: W.centred(y, n, sums))
    _, centred, _, _ = brute(x)
    assert n == 50 and np.allclose(r.T @ r, centred.T @ centred)
