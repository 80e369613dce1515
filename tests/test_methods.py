"""Arithmetic, indexing and methods of arrays against NumPy."""

import numpy as np
import pytest

from gridloom import methods
from gridloom.arrays import array

X = np.arange(24.0).reshape(2, 3, 4) - 7


@pytest.mark.parametrize(
    "f",
    [
        lambda a: a + 1, lambda a: 2 - a, lambda a: a * a, lambda a: a / 4, lambda a: a // 4, lambda a: -a, lambda a: abs(a), lambda a: a > 2, lambda a: a[0], lambda a: a[:, ::-1, 1:3],
        lambda a: a[..., -1], lambda a: a[:, None, 1], lambda a: a[1, ::2], lambda a: a.T, lambda a: a.reshape(4, -1), lambda a: a.sum((0, 2)), lambda a: a.mean(1), lambda a: a.std(), lambda a: a.max(-1),
        lambda a: a.argmax(2), lambda a: a.cumsum(1), lambda a: a.clip(-2, 5), lambda a: a.transpose(1, 0, 2), lambda a: a.swapaxes(0, 2), lambda a: a @ a.swapaxes(1, 2), lambda a: a[a > 3], lambda a: a.ptp(0) if not isinstance(a, np.ndarray) else np.ptp(a, 0),
    ],
)
def test_like_numpy(spark, f):
    ours, theirs = f(array(spark, X)), np.asarray(f(X))
    assert ours.shape == theirs.shape
    np.testing.assert_allclose(np.asarray(ours.collect(), float), np.asarray(theirs, float))


def test_scalars_and_equality(spark):
    a = array(spark, X)
    assert a.item(1, 2, 3) == X[1, 2, 3] and a.item(5) == X.reshape(-1)[5] and float(a[0, 0, 0]) == X[0, 0, 0]
    assert methods.array_equal(a, a + 0.0) and not methods.array_equal(a, a + 1) and not methods.array_equal(a, a[0])
    assert methods.allclose(a, a + 1e-12) and a.count_nonzero() == np.count_nonzero(X) and a.nbytes == X.nbytes
    with pytest.raises(IndexError):
        a[5]


def test_reflected_and_assigned(spark):
    values = np.arange(1.0, 7.0).reshape(2, 3)
    a = array(spark, values)
    assert np.allclose((7 % a).collect(), 7 % values) and np.allclose((7 // a).collect(), 7 // values)
    whole = array(spark, np.array([[3, 4], [5, 2]]))
    assert np.array_equal((7 % whole).collect(), 7 % np.array([[3, 4], [5, 2]]))
    assert np.allclose((np.ones((1, 2)).tolist() @ a).collect(), np.ones((1, 2)) @ values)
    wanted = values.copy()
    wanted[:, 1:] = [[9.0, 8.0], [7.0, 6.0]]
    assert np.allclose(a.assigned((slice(None), slice(1, None)), array(spark, [[9.0, 8.0], [7.0, 6.0]])).collect(), wanted)
    assert a.tobytes() == values.tobytes()
    with pytest.raises(ValueError):
        a.assigned(0, array(spark, [1.0]))


def test_moments(spark):
    values = np.array([[1.0, 2.0, 4.0], [3.0, 3.0, 3.0]])
    a = array(spark, values)
    deviations = values - values.mean(1, keepdims=True)
    assert np.allclose(a.moment(3, 1).collect(), (deviations**3).mean(1))
    assert np.allclose(a.skew(1).collect(), [(deviations[0] ** 3).mean() / (deviations[0] ** 2).mean() ** 1.5, 0.0])
    assert a.kurtosis(1).collect()[1] == 0.0


def test_files(spark, tmp_path):
    from gridloom.sources import files

    (tmp_path / "t.txt").write_text("a b\n# note\n1 2\n3  4 # more\n\n5 6\nend\n")
    path = str(tmp_path / "t.txt")
    assert [tuple(r) for r in files.loadtxt(spark, path, ["x", "y"], skip_header=1, max_rows=2).collect()] == [(1.0, 2.0), (3.0, 4.0)]
    got = files.genfromtxt(spark, path, ["x", "y"], delimiter=" ", skip_header=2, skip_footer=1).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    (tmp_path / "n.txt").write_text("1, 2,\n3.5")
    assert [r.v for r in files.fromfile(spark, str(tmp_path / "n.txt"), sep=",").orderBy("i0").collect()] == [1.0, 2.0, 3.5]
    for values in (np.array([2**53 + 1, -1]), np.array([1 + 2j, 3 - 4j]), np.array([True, False]), np.array([[1.5, 2.5]])):
        np.save(tmp_path / "a.npy", values)
        assert np.array_equal(files.load_npy(spark, str(tmp_path / "a.npy")).collect(), values)
    files.save_npz(str(tmp_path / "z.npz"), a=array(spark, [1.0, 2.0]))
    assert files.load_npz(spark, str(tmp_path / "z.npz"))["a"].collect().tolist() == [1.0, 2.0]
