"""Matrices as square tiles, and products of tiles.

A tile is a row (ti, tj, data): dense doubles in row-major order, padded with zeros at
the edges. A product deals the result in square blocks of tiles. A group holds the left
tiles of a block's rows and the right tiles of its columns over a bounded stretch of the
contracted axis, and gives out one result tile after another; where there are several
stretches, their partial sums are added by a second grouping. Operands are copied once
for each block along the other side, so what is shuffled grows with n^3 / block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..arrays import Array
from ..storage import dealt, sent

#: Elements along an edge, and tiles of the contracted axis that a group multiplies.
TILE, STRETCH = 256, 8
#: Bytes of one operand that a group holds, and blocks along an edge that give enough groups.
HELD, BLOCKS = 64 << 20, 8

_DDL = "ti bigint, tj bigint, data binary"


def packed(x: np.ndarray) -> bytes:
    """The bytes of an array: none for zeros, compressed where that is shorter (so that plans carry and store fewer of them), else plain."""
    if not x.any():
        return b""
    plain = x.tobytes()
    short = pa.compress(plain, codec="zstd", asbytes=True)
    return short if len(short) < len(plain) else plain


def unpacked(data: bytes | pa.Buffer | None, rows: int, cols: int) -> np.ndarray:
    """The array of ``packed``, of plain bytes, or of none."""
    size = 8 * rows * cols
    if not data or not len(data):
        return np.zeros((rows, cols))
    return np.frombuffer(data if len(data) == size else pa.decompress(data, size, codec="zstd")).reshape(rows, cols)


def to_tiles(a: Array, tile: int = TILE, wide: int | None = None) -> DataFrame:
    """The tiles of a matrix that have an element, ``wide`` columns each (else square); a lacking tile is zero."""
    wide = wide or tile
    at = lambda x, size: F.floor(F.col(x) / size)
    cells = a.df.select(at("i0", tile).alias("ti"), at("i1", wide).alias("tj"), (F.col("i0") % tile * wide + F.col("i1") % wide).alias("at"), F.col("v").cast("double").alias("v"))

    def pack(table: pa.Table) -> pa.Table:
        dense = np.zeros(tile * wide)
        dense[table.column("at").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"ti": table.column("ti")[:1], "tj": table.column("tj")[:1], "data": pa.array([dense.tobytes()], pa.binary())})

    return cells.groupBy("ti", "tj").applyInArrow(pack, _DDL)


def made(at: DataFrame, x: Array, y: Array, f: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = TILE, pack: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """The tiles at (ti, tj) of a matrix that ``f`` makes of a block of rows of x and one of y, for x and y of few columns.

    They are made where they are used: a join of blocks of rows, without a shuffle of cells.
    """
    (n, r), (m, _) = x.shape, y.shape
    left = to_tiles(x, tile, r).select("ti", F.col("data").alias("x"))
    right = to_tiles(y, tile, r).select(F.col("ti").alias("tj"), F.col("data").alias("y"))
    both = at.join(sent(left, 8 * n * r), "ti").join(sent(right, 8 * m * r), "tj").select("ti", "tj", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ti, tj, p, q in zip(*(c.to_pylist() for c in batch.columns)):
                data, rows, cols = np.zeros((tile, tile)), min(tile, n - ti * tile), min(tile, m - tj * tile)
                data[:rows, :cols] = f(np.frombuffer(p).reshape(tile, r)[:rows], np.frombuffer(q).reshape(tile, r)[:cols])
                yield pa.RecordBatch.from_arrays([pa.array([ti]), pa.array([tj]), pa.array([pack(data)], pa.binary())], ["ti", "tj", "data"])

    return dealt(both.mapInArrow(run, _DDL))


def outer(x: Array, y: Array, tile: int = TILE) -> DataFrame:
    """The tiles of x y'. Each tile row is dealt out in order, so that a task has whole rows of tiles, or stretches of one."""
    rows, cols = -(-x.shape[0] // tile), -(-y.shape[0] // tile)
    at = x.df.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("ti"), (F.col("id") % cols).alias("tj"))
    return made(at, x, y, lambda p, q: p @ q.T, tile)


def from_tiles(tiles: DataFrame, shape: tuple[int, int], tile: int = TILE) -> Array:
    """Every element of a matrix of tiles, packed or plain."""

    def unpack(batches):
        for batch in batches:
            for ti, tj, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows, cols = min(tile, shape[0] - ti * tile), min(tile, shape[1] - tj * tile)
                dense = unpacked(data, tile, tile)[:rows, :cols]
                i, j = np.meshgrid(np.arange(rows) + ti * tile, np.arange(cols) + tj * tile, indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(dense.ravel())], ["i0", "i1", "v"])

    return Array(tiles.select("ti", "tj", "data").mapInArrow(unpack, "i0 bigint, i1 bigint, v double"), shape)


def block_edge(rows: int, inner: int, cols: int, tile: int, stretch: int = STRETCH) -> int:
    """Tiles along the edge of a block of the result: all that ``HELD`` bytes hold of an operand, as each block copies its operands."""
    return max(1, min(HELD // (8 * tile * tile * min(stretch, inner)), -(-max(rows, cols) // BLOCKS)))


def multiply(a: DataFrame, b: DataFrame, rows: int, inner: int, cols: int, tile: int = TILE, stretch: int = STRETCH) -> DataFrame:
    """The product of two matrices of tiles; ``rows``, ``inner`` and ``cols`` are the numbers of tiles along the axes.

    A result tile for which no tiles meet is lacking, that is zero.
    """
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    edge = block_edge(rows, inner, cols, tile, stretch)
    block = lambda x: F.floor(F.col(x) / edge)
    left = a.select(F.col("ti").alias("at"), F.col("tj").alias("k"), F.lit(0).alias("side"), "data", block("ti").alias("bi")).withColumn("bj", copies(-(-cols // edge)))
    right = b.select(F.col("tj").alias("at"), F.col("ti").alias("k"), F.lit(1).alias("side"), "data", block("tj").alias("bj")).withColumn("bi", copies(-(-rows // edge)))
    both = left.unionByName(right).withColumn("part", F.floor(F.col("k") / stretch))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for at, k, side, data in zip(*(batch.column(c).to_pylist() for c in ("at", "k", "side", "data"))):
                sides[side].setdefault(at, {})[k] = np.frombuffer(data).reshape(tile, tile)
        for ti, row in sides[0].items():
            for tj, col in sides[1].items():
                common = sorted(row.keys() & col.keys())
                if common:
                    total = sum(row[k] @ col[k] for k in common)
                    yield pa.RecordBatch.from_arrays([pa.array([ti]), pa.array([tj]), pa.array([total.tobytes()], pa.binary())], ["ti", "tj", "data"])

    parts = dealt(both.groupBy("bi", "bj", "part").applyInArrow(partial, _DDL))
    if inner <= stretch:
        return parts

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(tile * tile)
        for data in table.column("data"):
            total += np.frombuffer(data.as_py())
        return pa.table({"ti": table.column("ti")[:1], "tj": table.column("tj")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    return dealt(parts.groupBy("ti", "tj").applyInArrow(added, _DDL))


def matmul(a: Array, b: Array, tile: int = TILE) -> Array:
    """The product of two dense matrices of any size; elements that both lack give zero."""
    (n, m), (m2, p) = a.shape, b.shape
    if m != m2:
        raise ValueError(f"cannot multiply {a.shape} by {b.shape}")
    count = lambda x: -(-x // tile)
    return from_tiles(multiply(to_tiles(a, tile), to_tiles(b, tile), count(n), count(m), count(p), tile), (n, p), tile)
