"""Blocked factorisations and leading pairs against NumPy."""

import uuid

import numpy as np
import pyarrow as pa
import pytest

from gridloom.arrays import Array
from gridloom.operators import blocked, leading, linalg, tiles
from gridloom.storage import shared_dir


def cells(spark, x):
    n, m = x.shape
    return Array(spark.createDataFrame(pa.table({"i0": np.repeat(np.arange(n), m), "i1": np.tile(np.arange(m), n), "v": x.ravel()})).repartition(8), x.shape)


def dense(a):
    t = a.df.toArrow()
    out = np.full(a.shape, np.nan)
    out[tuple(t[x].to_numpy() for x in a.axes)] = t["v"].to_numpy()
    return out


@pytest.mark.parametrize("n, m, tile", [(130, 70, 32), (64, 1, 16), (7, 3, 16)])
def test_solve_by_tiles(spark, n, m, tile):
    """Rows that need pivots from other tiles: a zero at every corner, and growing rows."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, n)) * np.logspace(0, 3, n)[:, None]
    np.fill_diagonal(x, 0)
    b = rng.normal(size=(n, m))
    a = cells(spark, x)
    got = dense(blocked.solve(a, cells(spark, b), tile))
    np.testing.assert_allclose(got, np.linalg.solve(x, b), rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(dense(blocked.inv(a, tile)), np.linalg.inv(x), rtol=1e-6, atol=1e-9)
    sign, log = blocked.slogdet(a, tile)
    want = np.linalg.slogdet(x)
    assert sign == want[0] and log == pytest.approx(want[1], rel=1e-10)


def test_solve_a_million_elements(spark):
    rng = np.random.default_rng(2)
    x, b = rng.normal(size=(1030, 1030)), rng.normal(size=1030)
    right = Array(spark.createDataFrame(pa.table({"i0": np.arange(1030), "v": b})), (1030,))
    got = dense(blocked.solve(cells(spark, x), right, 256))
    assert np.abs(x @ got - b).max() < 1e-8


def test_cholesky_by_tiles(spark):
    rng = np.random.default_rng(3)
    for n, tile in ((1030, 256), (5, 8), (48, 16)):
        x = rng.normal(size=(n, n))
        x = x @ x.T + n * np.eye(n)
        np.testing.assert_allclose(dense(blocked.cholesky(cells(spark, x), tile)), np.linalg.cholesky(x), rtol=1e-9, atol=1e-9)
    with pytest.raises(np.linalg.LinAlgError):
        blocked.cholesky(cells(spark, -np.eye(20)), 8)


def test_singular_and_sparse(spark):
    """Elements that lack are zero; tiles fill in."""
    n = 40
    at = np.arange(n)
    one = Array(spark.createDataFrame(pa.table({"i0": np.r_[at, at], "i1": np.r_[(at + 1) % n, (at + 7) % n], "v": np.r_[np.full(n, 3.0), np.ones(n)]})), (n, n))
    x = np.zeros((n, n))
    x[at, (at + 1) % n], x[at, (at + 7) % n] = 3.0, 1.0
    assert blocked.det(one, 8) == pytest.approx(np.linalg.det(x), rel=1e-9)
    np.testing.assert_allclose(dense(blocked.inv(one, 8)), np.linalg.inv(x), atol=1e-10)
    bad = cells(spark, np.ones((20, 20)))
    assert blocked.det(bad, 8) == 0.0
    with pytest.raises(np.linalg.LinAlgError):
        blocked.inv(bad, 8)
    with pytest.raises(np.linalg.LinAlgError):
        blocked.inv(cells(spark, np.ones((2, 3))), 8)


def test_substitution_keeps_zeros(spark):
    """The inverse of a matrix of minima has three diagonals: its other tiles are zero, and cost no bytes, as does a right side of zeros."""
    n, tile = 24, 8
    total = np.cumsum(1 + np.arange(n) % 7 / 4.0)
    x = np.minimum(total[:, None], total)[::-1]
    np.testing.assert_allclose(dense(blocked.inv(cells(spark, x), tile)), np.linalg.inv(x), atol=1e-12)
    every = blocked._complete(tiles.to_tiles(cells(spark, x), tile), 3, 3, tile)
    kept = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    _, sign, _ = blocked._eliminated(every, n, 4, tile, kept)  # room for right sides
    assert abs(sign) == 1
    upper = np.zeros((n, n))
    for r in spark.read.schema("ti bigint, tj bigint, data binary").parquet(kept).collect():
        upper[r["ti"] * tile :, r["tj"] * tile :][:tile, :tile] = tiles.unpacked(bytes(r["data"]), tile, tile)
    assert not np.tril(upper, -1).any()
    np.testing.assert_allclose(np.abs(np.diag(upper)).prod(), np.abs(np.linalg.det(x)), rtol=1e-9)
    zero = Array(spark.range(n).selectExpr("id AS i0", "0.0D AS v"), (n,))
    np.testing.assert_array_equal(dense(blocked.solve(cells(spark, x), zero, tile)), np.zeros(n))


def test_leading_eigenpairs(spark):
    """Both signs, a million elements, and a matrix of zeros."""
    rng = np.random.default_rng(4)
    n = 1030
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = np.r_[10.0, -9.0, 7.0, 3.0, rng.uniform(-0.5, 0.5, n - 4)]
    x = q * values @ q.T
    x = (x + x.T) / 2
    found = leading.eigh(cells(spark, x), 4)
    np.testing.assert_allclose(found.values, [10, -9, 7, 3], atol=1e-8)
    v = dense(found.vectors)
    assert np.abs(x @ v - v * found.values).max() < 1e-7 and np.abs(v.T @ v - np.eye(4)).max() < 1e-10
    nothing = leading.eigh(cells(spark, np.zeros((5, 5))), 2, 4)
    assert nothing.values.size == 0 and nothing.vectors.df.count() == 0
    with pytest.raises(np.linalg.LinAlgError):
        leading.eigh(cells(spark, np.diag(np.linspace(1, 1.01, 60))), 3, 16, rounds=2)


@pytest.mark.parametrize("n, m, tile", [(3000, 350, 256), (90, 200, 32)])
def test_leading_singular_values(spark, n, m, tile):
    rng = np.random.default_rng(n)
    u, _ = np.linalg.qr(rng.normal(size=(n, 12)))
    w, _ = np.linalg.qr(rng.normal(size=(m, 12)))
    x = u * np.logspace(3, -2, 12) @ w.T
    found = leading.svd(cells(spark, x), 5, tile)
    np.testing.assert_allclose(found.values, np.logspace(3, -2, 12)[:5], rtol=1e-9)
    left, right = dense(found.left), dense(found.vectors)
    assert np.abs(x @ right - left * found.values).max() < 1e-6 and np.abs(left.T @ left - np.eye(5)).max() < 1e-8
    low = leading.svd(cells(spark, np.outer(np.arange(50.0), np.ones(20))), 3, 16)
    assert len(low.values) == 1 and low.values[0] == pytest.approx(np.linalg.norm(np.arange(50.0)) * np.sqrt(20))


def test_sizes_choose_the_method(spark, monkeypatch):
    """The functions of small matrices take the distributed way beyond a side."""
    monkeypatch.setattr(linalg, "SIDE", 20)
    rng = np.random.default_rng(6)
    x, b = rng.normal(size=(30, 30)), rng.normal(size=30)
    a, right = cells(spark, x), Array(spark.createDataFrame(pa.table({"i0": np.arange(30), "v": b})), (30,))
    np.testing.assert_allclose(linalg.solve(a, right).collect(), np.linalg.solve(x, b), rtol=1e-8)
    assert linalg.det(a).collect() == pytest.approx(np.linalg.det(x), rel=1e-9)
    np.testing.assert_allclose(linalg.slogdet(a).collect(), np.linalg.slogdet(x), rtol=1e-9)
    assert linalg.norm(cells(spark, x + 5), 2).collect() == pytest.approx(np.linalg.norm(x + 5, 2), rel=1e-8)
    y = rng.normal(size=(40, 3))
    long = cells(spark, y)
    np.testing.assert_allclose(linalg.svdvals(long).collect(), np.linalg.svd(y, compute_uv=False), rtol=1e-10)
    assert linalg.cond(long).collect() == pytest.approx(np.linalg.cond(y)) and linalg.matrix_rank(long).collect() == 3
