"""What Python makes counts as small in a plan: joins must not send it through the driver."""

import glob

import numpy as np
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from gridloom import storage
from gridloom.arrays import Array, grid
from gridloom.operators import blocked, leading, numeric, tiles
from gridloom.operators.random import Generator
from gridloom.plans import catalog, factors
from gridloom.storage import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_not_broadcast(spark):
    """A matrix made from few rows: its tiles, and the pairs of rows that it is made of."""
    found = tiles.to_tiles(grid(spark, (300, 300)).map(lambda v: v.cast("double")), 64)
    assert "Broadcast" not in plan(blocked._complete(found, 5, 5, 64))
    pairs = plan(factors.minima(spark, "/root/testdata/sf0.001").df)
    assert "BuildRight" in pairs and "BuildLeft" not in pairs  # the totals are sent, not the pairs


def test_draws_are_not_broadcast(spark):
    drawn = Generator(spark, 1).normal(0.0, 1.0, size=(1000,)).map(lambda v: v + 1).df
    assert "Broadcast" not in plan(drawn.join(spark.range(1000).withColumnRenamed("id", "i0"), "i0"))


def test_transforms_are_not_broadcast(spark):
    """The product of two transforms, one of them of a short array."""
    a, b = (grid(spark, (n,)).map(lambda v: v.cast("double")) for n in (5000, 300))
    assert "Broadcast" not in plan(numeric.convolve(a, b, max_kernel=0).df)


def test_type_functions_are_all_called(spark):
    """The query has each function of types, not two of them."""
    row = catalog.QUERIES["type_functions"](spark, "/root/testdata/sf0.001").first().asDict()
    assert row == {"promoted": "float64", "wide": "int64", "safe": True, "narrow": False, "kind": True, "most": 2**63 - 1, "eps": 2.0**-52, "n": 1500}


def test_outer_tiles_and_their_pairs(spark, monkeypatch):
    """Tiles of x y' are made where they are used: the matrix is never written."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    cells = lambda m: Array(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(50) for j in range(2)], "i0 bigint, i1 bigint, v double"), m.shape)
    made = tiles.outer(cells(x), cells(x[:, ::-1]), 16)
    want = x @ x[:, ::-1].T
    got = np.zeros((64, 64))
    for r in made.collect():
        got[r["ti"] * 16 :, r["tj"] * 16 :][:16, :16] = np.frombuffer(r["data"]).reshape(16, 16)
    np.testing.assert_allclose(got[:50, :50], want, atol=1e-12)
    names = []
    monkeypatch.setattr(leading, "stored", lambda df, name: names.append(name) or stored(df, name))
    values = leading.eigh_tiles(made, 50, 2, 16).values
    every = np.linalg.eigvalsh(want)
    np.testing.assert_allclose(values, every[np.argsort(-np.abs(every))][:2], atol=1e-9)
    assert "tiles" not in names


def test_tiles_of_a_narrow_matrix_are_narrow(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(leading, "stored", lambda df, name: sizes.append(df.selectExpr("sum(length(data))").first()[0]) or stored(df, name) if name == "tiles" else stored(df, name))
    a = grid(spark, (600, 2)).map(lambda v: F.sqrt(v))
    found = leading.svd(a, 1, 128)
    np.testing.assert_allclose(found.values, np.linalg.svd(np.sqrt(np.arange(1200.0)).reshape(600, 2), compute_uv=False)[:1])
    assert sizes == [640 * 2 * 8]


@pytest.mark.parametrize("m", [10, 90])
def test_products_by_blocks(spark, monkeypatch, m):
    """Several blocks with several tiles each, with one stretch and with more."""
    monkeypatch.setattr(tiles, "HELD", 8 * 8 * 8 * 8 * 2)
    rng = np.random.default_rng(m)
    a, b = rng.normal(size=(40, m)), rng.normal(size=(m, 50))
    cells = lambda x: Array(spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "i0 bigint, i1 bigint, v double"), x.shape)
    np.testing.assert_allclose(tiles.matmul(cells(a), cells(b), 8).collect(), a @ b, atol=1e-12)


def test_minima_are_made_as_tiles(spark):
    """The tiles hold what the elements hold, and no element of the matrix is shuffled to make them."""
    sf = "/root/testdata/sf0.001"
    matrix, n, tile = factors.minima_tiles(spark, sf, True)
    got = tiles.from_tiles(matrix, (n, n), tile).collect()
    np.testing.assert_array_equal(got, factors.minima(spark, sf, True).collect())
    assert "least" not in plan(matrix)


def test_steps_do_not_shuffle_the_matrix(spark, monkeypatch):
    """However long a column of tiles is; and a file has few tiles, as a reader may hold all of it."""
    monkeypatch.setattr(storage, "SENT", 0)
    monkeypatch.setattr(blocked, "FILE", 2 * 8 * 8 * 8, raising=False)
    x = np.random.default_rng(5).normal(size=(40, 40))
    x = x @ x.T + 40 * np.eye(40)
    a = Array(spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "i0 bigint, i1 bigint, v double"), x.shape)
    before = set(glob.glob(f"{storage.shared_dir(spark)}/*"))
    np.testing.assert_allclose(blocked.slogdet(a, 8), np.linalg.slogdet(x))
    np.testing.assert_allclose(blocked.cholesky(a, 8).collect(), np.linalg.cholesky(x), atol=1e-12)
    made = set(glob.glob(f"{storage.shared_dir(spark)}/*")) - before
    files = [f for d in made for f in glob.glob(f"{d}/**/*.parquet", recursive=True)]
    assert len(files) > 20 and max(parquet.read_metadata(f).num_rows for f in files) <= 2
    now = stored(blocked._complete(tiles.to_tiles(a, 8), 5, 5, 8), "tiles")
    free, lower = np.arange(40) >= 8, f"{storage.shared_dir(spark)}/lower"
    assert "Exchange" not in plan(blocked._step(now, 0, blocked._factor(x[:8, :8])[1], free, 8, f"{storage.shared_dir(spark)}/upper", lower))


def test_packed_arrays():
    rng = np.random.default_rng(6)
    for x in (np.zeros((4, 4)), rng.normal(size=(4, 4)), np.ones((64, 32)), np.arange(2048.0).reshape(64, 32)):
        np.testing.assert_array_equal(tiles.unpacked(tiles.packed(x), *x.shape), x)
        np.testing.assert_array_equal(tiles.unpacked(x.tobytes(), *x.shape), x)
    assert tiles.packed(np.zeros((4, 4))) == b"" and len(tiles.packed(np.ones((64, 32)))) < 200


def test_blocks_of_products_are_as_large_as_memory_allows():
    """360,000 rows of 100 columns in tiles of 32: eight blocks a side, so operands are copied eight times, not 88."""
    rows = -(-360_000 // 32)
    assert -(-rows // tiles.block_edge(rows, 4, rows, 32)) == 8
    assert tiles.block_edge(10**6, 10**6, 10**6, 32) * 8 * 32 * 32 * tiles.STRETCH <= tiles.HELD
