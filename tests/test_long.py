"""Long arrays against NumPy: a million elements, odd lengths, skew, ties and empty parts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.arrays import Array, array
from gridloom.operators import fourier, linalg, numeric, scans, selection, tall, tiles

N = 1 << 20


def long_array(spark, values):
    """A 1-D array in several partitions, from NumPy."""
    table = pa.table({"i0": np.arange(len(values)), "v": np.asarray(values)})
    return Array(spark.createDataFrame(table).repartition(8), (len(values),))


def numpy_of(a):
    """The values in order, complex ones too."""
    flat = a.df.select(a.flat().alias("at"), *([F.col("v.re").alias("re"), F.col("v.im").alias("im")] if "struct" in a.dtype else [F.col("v").alias("re")]))
    t = flat.toArrow()
    out = np.full(a.size, np.nan, complex if "struct" in a.dtype else float)
    out[t["at"].to_numpy()] = t["re"].to_numpy() + (1j * t["im"].to_numpy() if "struct" in a.dtype else 0)
    return out.reshape(a.shape)


def close(a, b, scale=1.0):
    assert a.shape == b.shape and np.abs(a - b).max() < 1e-9 * scale


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).normal(size=N)


def test_fft_of_a_million(spark, noise):
    a = long_array(spark, noise)
    close(numpy_of(fourier.fft(a)), np.fft.fft(noise), 1e3)


@pytest.mark.parametrize("n", [4098, 10_007, 12_100])
def test_fft_lengths(spark, n):
    """A product of few numbers, a prime, and a square."""
    x = np.random.default_rng(n).normal(size=n)
    a = long_array(spark, x)
    close(numpy_of(fourier.fft(a)), np.fft.fft(x), 1e2)
    z = np.fft.rfft(x)
    half = Array(fourier.rfft(a).df, (len(z),))
    close(numpy_of(half), z, 1e2)
    close(numpy_of(fourier.irfft(half, n=n)), x, 10)
    close(numpy_of(fourier.ihfft(a)), np.fft.ihfft(x), 10)
    close(numpy_of(fourier.hfft(half, n=n)), np.fft.hfft(z, n), 1e5)
    close(numpy_of(fourier.ifft(a)), np.fft.ifft(x), 10)


def test_fft_long_lanes(spark):
    x = np.random.default_rng(3).normal(size=(3, 5000))
    a = Array(spark.createDataFrame(pa.table({"i0": np.repeat(np.arange(3), 5000), "i1": np.tile(np.arange(5000), 3), "v": x.ravel()})), (3, 5000))
    close(numpy_of(fourier.fft2(a)), np.fft.fft2(x), 1e3)
    close(numpy_of(fourier.fft(a, 0)), np.fft.fft(x, axis=0), 10)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_quantile_of_three_million(spark, q):
    rows = spark.range(3_000_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 1_000_003).cast("double")).alias("v"))
    x = np.arange(3_000_000)
    want = np.quantile(np.where(x % 3 == 0, 7.0, x * 7919 % 1_000_003), q)
    assert selection.quantiles(rows, "v", [q])[0] == pytest.approx(want, rel=1e-15)


def test_selection_edges(spark):
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=5000), np.zeros(5000), rng.integers(0, 3, 5000).astype(float), np.r_[np.full(4000, 1.0), rng.exponential(size=1000)], np.r_[-np.inf, np.inf, rng.normal(size=3000)], np.array([3.0])):
        df = long_array(spark, x).df
        shares = [0, 0.1, 0.5, 0.77, 1]
        got = selection.quantiles(df, "v", shares, few=10)
        srt = np.sort(x)
        places = [s * (len(x) - 1) for s in shares]
        assert all(srt[int(np.floor(p))] <= g <= srt[int(np.ceil(p))] for p, g in zip(places, got))
        ranks = sorted({0, len(x) // 2, len(x) - 1})
        assert [selection.select_ranks(df, "v", ranks, few=5)[r] for r in ranks] == srt[ranks].tolist()
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert np.isnan(selection.median(df, "v")) and selection.nanmedian(df, "v") == 2.0
    assert selection.median(df.filter("v is null"), "v") is None
    assert [r.v for r in selection.nanpercentile(df, "v", [0, 100]).orderBy("q").collect()] == [1.0, 3.0]


def test_partition(spark):
    x = np.random.default_rng(6).integers(0, 50, 20_000).astype(float)
    x[::97] = np.nan
    for kth in (0, 9_000, 19_900, -1):
        out = selection.partitioned(long_array(spark, x), kth).toArrow()
        got = np.full(len(x), -1.0)
        got[out["i0"].to_numpy()] = out["v"].to_numpy()
        k, srt = kth % len(x), np.sort(x)
        assert np.array_equal(got[k], srt[k], equal_nan=True) and np.array_equal(np.sort(got), srt, equal_nan=True)
        assert np.array_equal(np.sort(got[:k]), srt[:k], equal_nan=True)
        assert np.array_equal(x[out["was"].to_numpy()], out["v"].to_numpy(), equal_nan=True) and len(set(out["i0"].to_pylist())) == len(x)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolve_long(spark, noise, mode):
    for n, m, most in ((40_000, 3, 1 << 16), (50_000, 9000, 1 << 16), (7000, 12_000, 0), (100, 5000, 1 << 16)):
        x, y = noise[:n], noise[N - m :]
        want = np.convolve(x, y, mode)
        close(numpy_of(numeric.convolve(long_array(spark, x), long_array(spark, y), mode, most)), want, 1e3)
        close(numpy_of(numeric.correlate(long_array(spark, x), long_array(spark, y), mode, most)), np.convolve(x, y[::-1], mode), 1e3)
    close(numpy_of(numeric.convolve(long_array(spark, x), [1.0, 2.0, 3.0], mode)), np.convolve(x, [1.0, 2.0, 3.0], mode))


def test_convolve_a_million(spark, noise):
    kernel = noise[:20_000]
    got = numpy_of(numeric.convolve(long_array(spark, noise), long_array(spark, kernel)))
    length = 1 << 21
    want = np.fft.irfft(np.fft.rfft(noise, length) * np.fft.rfft(kernel, length), length)[: N + len(kernel) - 1]
    close(got, want, 1e3)


def test_interp_table(spark):
    """Thousands of points, skewed queries, and parts without a point."""
    rng = np.random.default_rng(7)
    xp = np.sort(rng.choice(np.r_[np.arange(3000.0), np.arange(9000.0, 9010.0)], 2500, replace=False))
    fp = rng.normal(size=len(xp))
    x = np.r_[rng.uniform(-100, 10_000, 200_000), np.full(100_000, 17.25), xp[:100], [np.nan]]
    queries = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "x": x, "before": np.arange(len(x))})).repartition(8)
    points = spark.createDataFrame(pa.table({"xp": xp, "fp": fp}))
    out = scans.interp(queries, "x", points, "xp", "fp").toArrow()
    got = np.empty(len(x))
    got[out["id"].to_numpy()] = out["interp"].to_numpy()
    np.testing.assert_allclose(got, np.interp(x, xp, fp), rtol=1e-9, atol=1e-12)
    edges = np.sort(np.r_[xp, xp[:50]])
    bins = spark.createDataFrame(pa.table({"edge": rng.permutation(edges)}))
    for right in (False, True):
        out = scans.digitize(queries, "x", bins, "edge", right=right).toArrow()
        got = np.empty(len(x), int)
        got[out["id"].to_numpy()] = out["bin"].to_numpy()
        assert np.array_equal(got, np.digitize(x, edges, right=right))
    joined = scans.asof_join(queries.limit(5), "x", points, "xp", ["fp"])
    assert joined.columns == ["id", "x", "before", "fp"]
    empty = scans.interp(queries.limit(3), "x", points.limit(0), "xp", "fp")
    assert [r.interp for r in empty.collect()] == [None] * 3


def test_tall_least_squares(spark):
    """A condition of 1e10, which a Gram matrix would lose."""
    rng = np.random.default_rng(8)
    m, n = 200_000, 5
    u, _ = np.linalg.qr(rng.normal(size=(m, n)))
    v, _ = np.linalg.qr(rng.normal(size=(n, n)))
    a = u * np.logspace(0, -10, n) @ v.T
    want = rng.normal(size=(n, 2))
    b = a @ want
    cells = lambda x: Array(spark.createDataFrame(pa.table({"i0": np.repeat(np.arange(len(x)), x.shape[1]), "i1": np.tile(np.arange(x.shape[1]), len(x)), "v": x.ravel()})).repartition(24), x.shape)
    left = cells(a)
    x, residuals, rank, s = tall.lstsq(left, cells(b))
    assert rank == n and np.abs(x - want).max() < 1e-5 and np.abs(s - np.logspace(0, -10, n)).max() < 1e-12 and residuals.max() < 1e-20
    assert tall.cond(left) == pytest.approx(1e10, rel=1e-4) and tall.matrix_rank(left) == n
    q, r = tall.qr(left)
    q = numpy_of(q)
    assert np.abs(q.T @ q - np.eye(n)).max() < 1e-12 and np.abs(q @ r - a).max() < 1e-12
    one, *_ = tall.lstsq(array(spark, a[:7]), array(spark, b[:7, 0]))
    np.testing.assert_allclose(a[:7] @ one, b[:7, 0], atol=1e-10)
    with pytest.raises(np.linalg.LinAlgError):
        tall.qr(array(spark, [[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]]))


def test_tiled_product(spark):
    rng = np.random.default_rng(9)
    cells = lambda x: Array(spark.createDataFrame(pa.table({"i0": np.repeat(np.arange(len(x)), x.shape[1]), "i1": np.tile(np.arange(x.shape[1]), len(x)), "v": x.ravel()})).repartition(8), x.shape)
    for (n, m, p), tile in (((1000, 1100, 700), 256), ((50, 333, 70), 16), ((3, 2, 4), 256)):
        a, b = rng.normal(size=(n, m)), rng.normal(size=(m, p))
        close(numpy_of(tiles.matmul(cells(a), cells(b), tile)), a @ b, 1e2)
    with pytest.raises(ValueError):
        tiles.matmul(cells(a), cells(a))


def test_contraction_order(spark, monkeypatch):
    """The cheapest order first, and the same result; large products go by tiles."""
    rng = np.random.default_rng(10)
    x = [rng.normal(size=s) for s in ((2, 30), (30, 40), (40, 3), (3,))]
    arrays = [array(spark, v) for v in x]
    assert linalg.einsum_path("ab,bc,cd,d->a", *arrays)[0] == (2, 3)
    np.testing.assert_allclose(linalg.einsum("ab,bc,cd,d->a", *arrays).collect(), np.einsum("ab,bc,cd,d->a", *x), rtol=1e-10)
    np.testing.assert_allclose(linalg.einsum("ab,cd,bc", *arrays[:1], arrays[2], arrays[1]).collect(), np.einsum("ab,cd,bc", x[0], x[2], x[1]), rtol=1e-10)
    assert linalg.einsum_path("ab->a", arrays[0]) == []
    many = [array(spark, np.eye(2))] * 10
    letters = "abcdefghijk"
    assert len(linalg.einsum_path(",".join(letters[k : k + 2] for k in range(10)) + "->ak", *many)) == 9
    monkeypatch.setattr(linalg, "TILED", 100)
    np.testing.assert_allclose(linalg.matmul(arrays[0], arrays[1]).collect(), x[0] @ x[1], rtol=1e-10)
    solution, *_ = linalg.lstsq(arrays[2], array(spark, x[2] @ x[3]))
    np.testing.assert_allclose(solution, x[3], rtol=1e-9)
