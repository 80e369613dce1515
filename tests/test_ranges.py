"""Array files in byte ranges against NumPy."""

import os

import numpy as np
import pyarrow as pa
import pytest

from gridloom.arrays import Array, array
from gridloom.sources import files, ranges


def dense(a):
    t = a.df.toArrow()
    assert t.num_rows == a.size
    v = t["v"].combine_chunks()
    values = v.field("re").to_numpy() + 1j * v.field("im").to_numpy() if pa.types.is_struct(v.type) else v.to_numpy(zero_copy_only=False)
    out = np.zeros(a.shape, values.dtype)
    out[tuple(t[x].to_numpy() for x in a.axes)] = values
    return out


@pytest.mark.parametrize("x", [
    np.arange(60.0).reshape(3, 4, 5), np.asfortranarray(np.arange(12).reshape(3, 4)), np.array([1 + 2j, 3 - 4j]), np.array([True, False, True]),
    np.array(["ab", "", "äbc"]), np.arange(7, dtype=">i2"), np.zeros((0, 3)), np.array(5.0), np.arange(5, dtype=np.float32),
])
def test_read_kinds(spark, tmp_path, x):
    path = str(tmp_path / "x.npy")
    np.save(path, x)
    got = dense(ranges.load_npy(spark, path, part=16))
    assert got.shape == x.shape and np.array_equal(got, x)
    assert np.array_equal(dense(files.load(spark, "file:" + path)), x)


def test_a_million_both_ways(spark, tmp_path):
    """Written by many tasks into one file that NumPy reads, and read back in many parts."""
    x = np.random.default_rng(1).normal(size=(1 << 10, 1 << 10))
    i, j = np.indices(x.shape)
    a = Array(spark.createDataFrame(pa.table({"i0": i.ravel(), "i1": j.ravel(), "v": x.ravel()})).repartition(8), x.shape)
    path = str(tmp_path / "x.npy")
    files.save_npy(a, path)
    assert np.array_equal(np.load(path), x) and os.listdir(tmp_path) == ["x.npy"]
    back = ranges.load_npy(spark, path, part=1 << 20)
    assert back.df.rdd.getNumPartitions() == 8 and np.array_equal(dense(back), x)
    ranges.tofile(a, str(tmp_path / "x.bin"), "<f4")
    assert np.array_equal(np.fromfile(tmp_path / "x.bin", "<f4"), x.ravel().astype("<f4"))


def test_write_edges(spark, tmp_path):
    path = str(tmp_path / "x.npy")
    for x in (np.array([[1 + 1j, 0], [2, 3j]]), np.array([True, False]), np.arange(3), np.zeros((0, 2))):
        files.save_npy(array(spark, x), path)  # replaces the file before
        assert np.array_equal(np.load(path), x)
    sparse = Array(spark.createDataFrame([(1, 5.0), (3, 7.0)], "i0 bigint, v double"), (5,))
    files.save_npy(sparse, path)
    assert np.load(path).tolist() == [0, 5, 0, 7, 0]
    for rows in ([(9, 1.0)], [(0, None)], [(0, 1.0), (0, 2.0), (1, 1.0)]):
        with pytest.raises(Exception):  # outside, null, more than there are places
            files.save_npy(Array(spark.createDataFrame(rows, "i0 bigint, v double"), (2,)), path)
    assert np.load(path).tolist() == [0, 5, 0, 7, 0] and os.listdir(tmp_path) == ["x.npy"]
    with pytest.raises(ValueError):
        files.save_npy(array(spark, ["a"]), path)


def test_archives(spark, tmp_path):
    x, y = np.arange(24).reshape(2, 3, 4), np.linspace(0, 1, 7)
    for save in (np.savez, np.savez_compressed):
        path = str(tmp_path / f"{save.__name__}.npz")
        save(path, x=x, y=y)
        got = files.load_npz(spark, path)
        assert got.keys() == {"x", "y"} and np.array_equal(dense(got["x"]), x) and np.array_equal(dense(got["y"]), y)
    assert ranges.stored_members(str(tmp_path / "savez_compressed.npz")) == {"x": None, "y": None}


def test_raw_files(spark, tmp_path):
    for k in range(2):
        np.arange(10 + k, dtype="<i4").tofile(tmp_path / f"{k}.bin")
    (tmp_path / "1.bin").open("ab").write(b"xy")
    rows = files.fromfile(spark, str(tmp_path / "*.bin"), "<i4", offset=8).collect()
    assert sorted((r.path[-5:], r.i0, r.v) for r in rows) == [(f"{k}.bin", i, i + 2) for k in range(2) for i in range(8 + k)]
    assert [r.v for r in files.fromfile(spark, str(tmp_path / "0.bin"), "<i4", count=2).orderBy("i0").collect()] == [0, 1]
