"""Operators against NumPy on small arrays, edge values included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.arrays import array
from gridloom.functions import char, complexes as cx, dates, dtypes, math as m, predicates as p
from gridloom.operators import fourier, linalg, numeric, reductions, shape, sorting, windows
from gridloom.operators.random import Generator

NAN, INF = float("nan"), float("inf")


def values(spark, rows, *columns):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    return [tuple(r) for r in df.select(*columns).collect()]


def same(x, y):
    np.testing.assert_allclose(np.asarray(x, float), np.asarray(y, float), rtol=1e-9, atol=1e-12)


def test_division_and_remainders(spark):
    rows = [(1, 0), (-1, 0), (0, 0), (7, -2), (-7, 3), (NAN, 1), (1, -0.0), (INF, 2)]
    got = values(spark, rows, m.divide("a", "b"), m.floor_divide("a", "b"), m.remainder("a", "b"))
    same([g[0] for g in got], [INF, -INF, NAN, -3.5, -7 / 3, NAN, -INF, INF])
    same([g[1] for g in got], [INF, -INF, NAN, -4, -3, NAN, -INF, INF])
    same([g[2] for g in got][3:5], [1, -1])


def test_logarithms_at_the_edges(spark):
    got = values(spark, [(0, 0), (-1, 0), (1, 0), (NAN, 0), (-2, 0)], m.log("a"), m.log10("a"), m.log1p("a"))
    same([g[0] for g in got], [-INF, NAN, 0, NAN, NAN])
    same([g[2] for g in got], [0, -INF, np.log(2), NAN, NAN])


def test_rounding_is_away_from_zero(spark):
    got = values(spark, [(2.5, 0), (-2.5, 0), (0.5, 0)], m.rint("a"))
    same([g[0] for g in got], [3, -3, 1])


def test_nextafter_spacing_frexp(spark):
    xs = [1.0, -1.0, 0.5, 3.7, -1e10, 0.0, 2.0**-1060]
    got = values(spark, [(x, 5.0) for x in xs], m.nextafter("a", "b"), m.spacing("a"), m.frexp("a")["mantissa"], m.frexp("a")["exponent"])
    assert [g[0] for g in got] == [float(np.nextafter(x, 5.0)) for x in xs]
    assert [g[1] for g in got][:6] == [float(abs(np.spacing(x))) if x > 0 else float(np.spacing(x)) for x in xs][:6]
    for x, g in zip(xs[:6], got):
        assert (g[2], g[3]) == np.frexp(x)


def test_nan_rules(spark):
    got = values(spark, [(1, NAN), (NAN, 2), (NAN, NAN), (3, 4)], m.maximum("a", "b"), m.minimum("a", "b"), m.fmax("a", "b"), m.fmin("a", "b"), p.equal("a", "a"), p.less("a", "b"))
    same([g[0] for g in got], [NAN, NAN, NAN, 4])
    same([g[1] for g in got], [NAN, NAN, NAN, 3])
    same([g[2] for g in got], [1, 2, NAN, 4])
    same([g[3] for g in got], [1, 2, NAN, 3])
    assert [g[4] for g in got] == [True, False, False, True]
    assert [g[5] for g in got] == [False, False, False, True]


def test_special_functions(spark):
    xs = [0.0, 0.3, 5.0, 29.0, 31.0, 100.0]
    same([g[0] for g in values(spark, [(x, 0) for x in xs], m.i0("a"))], np.i0(xs))
    got = values(spark, [(12, 18), (-12, 18), (0, 5), (0, 0), (7, 13)], m.gcd("a", "b"), m.lcm("a", "b"))
    assert got == [(6, 36), (6, 36), (5, 0), (0, 0), (1, 91)]


def test_complex_domain(spark):
    xs = [-2.0, -0.5, 0.5, 2.0]
    from numpy.lib import scimath

    for ours, theirs in ((cx.sqrt, scimath.sqrt), (cx.log, scimath.log), (cx.arccos, scimath.arccos), (cx.arcsin, scimath.arcsin), (cx.arctanh, scimath.arctanh)):
        got = [complex(g[0].re, abs(g[0].im)) for g in values(spark, [(x, 0) for x in xs], ours("a"))]
        want = [complex(z).real + 1j * abs(complex(z).imag) for z in theirs(xs)]
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_strings(spark):
    words = ["hello", "WORLD", "tEsT", "hello123", "-42", "a-b-c", "", "a\tbb\tc", "it's tItle", "  x "]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    pairs = [
        (char.title("s"), str.title), (char.capitalize("s"), str.capitalize), (char.swapcase("s"), str.swapcase), (char.zfill("s", 6), lambda w: w.zfill(6)), (char.center("s", 9, "*"), None),
        (char.expandtabs("s", 4), lambda w: w.expandtabs(4)), (char.find("s", "l", 1), lambda w: w.find("l", 1)), (char.rfind("s", "l", 0, -1), lambda w: w.rfind("l", 0, -1)),
        (char.replace("s", "-", "+", 1), lambda w: w.replace("-", "+", 1)), (char.count("s", "l"), lambda w: w.count("l")), (char.strip("s"), str.strip), (char.join(".", "s"), lambda w: ".".join(w)),
        (char.partition("s", "-"), lambda w: list(w.partition("-"))), (char.rpartition("s", "-"), lambda w: list(w.rpartition("-"))), (char.startswith("s", "e", 1), lambda w: w.startswith("e", 1)),
        (char.isupper("s"), str.isupper), (char.islower("s"), str.islower), (char.isdigit("s"), str.isdigit),
    ]
    for column, f in pairs:
        got = [r[0] for r in df.select(column).collect()]
        if f:
            assert got == [f(w) for w in words], column


def test_business_days(spark):
    mask = [True, True, True, True, True, False, False]
    holidays = ["2023-06-19", "2023-07-04"]
    calendar = dates.BusDayCalendar(mask, holidays)
    days = np.arange("2023-06-01", "2023-07-20", dtype="datetime64[D]")
    df = spark.createDataFrame([(str(d), k) for k, d in enumerate(days)], "d string, k int").withColumn("d", F.col("d").cast("date"))
    got = df.select("k", dates.is_busday("d", calendar), dates.busday_count(F.lit("2023-06-03").cast("date"), "d", calendar), dates.busday_offset("d", F.lit(3), calendar)).orderBy("k").collect()
    npcal = np.busdaycalendar(holidays=holidays)
    assert [r[1] for r in got] == np.is_busday(days, busdaycal=npcal).tolist()
    assert [r[2] for r in got] == np.maximum(0, np.busday_count("2023-06-03", days, busdaycal=npcal)).tolist()
    working = [k for k, d in enumerate(days) if np.is_busday(d, busdaycal=npcal)]
    assert [got[k][3] for k in working] == [np.busday_offset(days[k], 3, busdaycal=npcal).item() for k in working]


A = np.arange(24.0).reshape(2, 3, 4)


@pytest.mark.parametrize(
    "ours,theirs",
    [
        (lambda a: shape.transpose(a, [2, 0, 1]), lambda x: x.transpose(2, 0, 1)),
        (lambda a: shape.reshape(a, (4, -1)), lambda x: x.reshape(4, -1)),
        (lambda a: shape.roll(a, 5), lambda x: np.roll(x, 5)),
        (lambda a: shape.rollaxis(a, 2), lambda x: np.rollaxis(x, 2)),
        (lambda a: shape.flip(a, (0, 2)), lambda x: np.flip(x, (0, 2))),
        (lambda a: shape.rot90(a, 3), lambda x: np.rot90(x, 3)),
        (lambda a: shape.moveaxis(a, [0, 1], [-1, 0]), lambda x: np.moveaxis(x, [0, 1], [-1, 0])),
        (lambda a: shape.pad(a, 1), lambda x: np.pad(x, 1)),
        (lambda a: shape.pad(a, 1, "edge"), lambda x: np.pad(x, 1, "edge")),
        (lambda a: shape.tile(a, (2, 1, 2)), lambda x: np.tile(x, (2, 1, 2))),
        (lambda a: shape.diagonal(a), lambda x: np.diagonal(x)),
        (lambda a: windows.diff(a, 2), lambda x: np.diff(x, 2)),
        (lambda a: windows.cumsum(a), lambda x: np.cumsum(x)),
        (lambda a: windows.cumprod(a, 0), lambda x: np.cumprod(x, 0)),
        (lambda a: reductions.reduce_axes(a, reductions.var, (0, 2)), lambda x: x.var((0, 2))),
        (lambda a: reductions.apply_over_axes(reductions.sum, a, [0, 2]), lambda x: np.apply_over_axes(np.sum, x, [0, 2])),
        (lambda a: numeric.gradient(a, 1.0, 1), lambda x: np.gradient(x, axis=1)),
        (lambda a: numeric.trapezoid(a), lambda x: np.trapezoid(x)),
        (lambda a: linalg.tensordot(a, shape.transpose(a), 1), lambda x: np.tensordot(x, x.T, 1)),
        (lambda a: linalg.einsum("ijk,ilk->jl", a, a), lambda x: np.einsum("ijk,ilk->jl", x, x)),
        (lambda a: linalg.matmul(a, shape.swapaxes(a, 1, 2)), lambda x: x @ x.swapaxes(1, 2)),
        (lambda a: sorting.sort(a.map(lambda v: -v), 1), lambda x: np.sort(-x, 1)),
    ],
)
def test_array_operators(spark, ours, theirs):
    same(ours(array(spark, A)).collect(), theirs(A))


def test_factorisations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4, 4))
    spd = x @ x.T + np.eye(4)
    a, s = array(spark, x), array(spark, spd)
    same(linalg.inv(a).collect(), np.linalg.inv(x))
    same(float(linalg.det(a).collect()), np.linalg.det(x))
    same(linalg.cholesky(s).collect(), np.linalg.cholesky(spd))
    same(linalg.solve(a, array(spark, np.ones(4))).collect(), np.linalg.solve(x, np.ones(4)))
    q, r = linalg.qr(a)
    same(q.collect() @ r.collect(), x)
    u, d, v = linalg.svd(a)
    same(u.collect() * d.collect() @ v.collect(), x)
    batch = rng.normal(size=(3, 2, 2))
    same(linalg.inv(array(spark, batch)).collect(), np.linalg.inv(batch))


def test_fourier(spark):
    x = np.random.default_rng(1).normal(size=(3, 8))
    np.testing.assert_allclose(fourier.fft(array(spark, x)).collect(), np.fft.fft(x), atol=1e-9)
    np.testing.assert_allclose(fourier.rfftn(array(spark, x)).collect(), np.fft.rfftn(x), atol=1e-9)
    np.testing.assert_allclose(fourier.irfftn(fourier.rfftn(array(spark, x))).collect(), x, atol=1e-9)
    np.testing.assert_allclose(fourier.hfft(fourier.ihfft(array(spark, x))).collect(), x, atol=1e-9)


def test_convolve_modes(spark):
    x, k = np.arange(7.0), [1.0, -2.0, 0.5]
    for mode in ("full", "same", "valid"):
        same(numeric.convolve(array(spark, x), k, mode).collect(), np.convolve(x, k, mode))
        same(numeric.correlate(array(spark, x), k, mode).collect(), np.correlate(x, k, mode))


def test_selection(spark):
    x = np.array([0.0, 0, 3, 1, 0, 5, 0])
    a = array(spark, x)
    same(shape.trim_zeros(a).collect(), np.trim_zeros(x))
    same(shape.take(a, array(spark, [3, -2, 3])).collect(), x[[3, -2, 3]])
    same(shape.insert(a, 2, array(spark, [9.0, 8.0])).collect(), np.insert(x, 2, [9, 8]))
    same(shape.delete(a, -1).collect(), np.delete(x, -1))
    same(windows.ediff1d(a, [1.0], [2.0]).collect(), np.ediff1d(x, 1.0, 2.0))
    y = x.copy()
    np.place(y, y > 0, [1, 2])
    same(shape.place(a, lambda v: v > 0, [1.0, 2.0]).collect(), y)


def test_unwrap(spark):
    x = np.array([0.0, 3, 6.5, -3, 2, 9, 9.1])
    same(windows.unwrap(array(spark, x)).collect(), np.unwrap(x))


def test_random_is_reproducible(spark):
    one = Generator(spark, 3).normal(1.0, 2.0, size=70000)
    two = Generator(spark, 3).normal(1.0, 2.0, size=70000)
    assert one.df.agg(F.sum("v")).first() == two.df.agg(F.sum("v")).first()
    mean, std = one.df.agg(F.avg("v"), F.stddev("v")).first()
    assert abs(mean - 1) < 0.05 and abs(std - 2) < 0.05
    g = Generator(spark, 4)
    assert sorted(g.permutation(50).collect().tolist()) == list(range(50))
    assert g.geometric(0.5, size=1000).df.agg(F.min("v")).first()[0] == 0
    assert g.dirichlet([1.0, 2.0, 3.0], size=5).collect().shape == (5, 3)
    assert len(set(g.choice(10, size=10, replace=False).collect().tolist())) == 10


def test_promotion():
    assert dtypes.promote_types("int32", "uint32") == "int64"
    assert dtypes.promote_types("uint64", "int64") == "float64"
    assert dtypes.promote_types("int64", "float32") == "float64"
    assert dtypes.promote_types("float64", "complex64") == "complex128"
    assert dtypes.can_cast("int8", "int64") and not dtypes.can_cast("int64", "int8")


def test_user_functions(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("x"))
    twice = numeric.vectorize(lambda v: v * 2)
    assert [r[0] for r in df.select(twice("x")).collect()] == [0, 2, 4, 6, 8]
    same(numeric.apply_along_axis(lambda v: v[::-1], 1, array(spark, A[0])).collect(), A[0][:, ::-1])


def test_files(spark, tmp_path):
    from gridloom.sources import files

    np.save(tmp_path / "x.npy", A)
    same(files.load(spark, str(tmp_path / "x.npy")).collect(), A)
    files.save(array(spark, A), str(tmp_path / "native"))
    same(files.load(spark, str(tmp_path / "native")).collect(), A)
    (tmp_path / "t.txt").write_text("# note\n1 2\n3 4\n")
    assert [tuple(r) for r in files.loadtxt(spark, str(tmp_path / "t.txt"), ["a", "b"]).collect()] == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "m.csv").write_text("1,,x\n4,5,6\n")
    got = [tuple(r) for r in files.genfromtxt(spark, str(tmp_path / "m.csv"), ["a", "b", "c"], filling=-1.0).collect()]
    assert got == [(1.0, -1.0, -1.0), (4.0, 5.0, 6.0)]


def test_empty_and_nan_reductions(spark):
    empty = spark.createDataFrame([], "v double")
    got = empty.agg(reductions.sum("v"), reductions.prod("v"), reductions.mean("v"), reductions.max("v"), reductions.min("v"), reductions.all("v"), reductions.any("v")).first()
    assert got[0] == 0 and got[1] == 1 and np.isnan(got[2]) and got[3] == -INF and got[4] == INF and got[5] and not got[6]
    nans = spark.createDataFrame([(NAN,), (NAN,)], "v double")
    got = nans.agg(reductions.nansum("v"), reductions.nanprod("v"), reductions.nanmean("v"), reductions.nanmax("v")).first()
    assert got[0] == 0 and got[1] == 1 and np.isnan(got[2]) and np.isnan(got[3])
