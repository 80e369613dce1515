"""Leading eigenpairs and singular triples of large matrices.

A block of vectors (a few more than wanted, random at first) is multiplied by the
matrix again and again. A product is a join of tiles with blocks of the vectors by tile
column and a grouped sum by tile row; between products the block is made orthonormal by
the tree of triangular factors (:mod:`tall`), which also gives the projected matrix and
the residuals, so that a round decides for itself whether the pairs have converged. Only
matrices as small as the block come to the driver.

Elements that lack are zero. A matrix of lower rank than the block gives a smaller
block, down to none for a matrix of zeros. Without convergence in ``rounds`` rounds
``LinAlgError`` is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array
from ..storage import Alternating, dealt, sent, stored
from . import tall, tiles

#: Vectors beyond those wanted, and the rounds after which no convergence is an error.
SPARE, ROUNDS = 8, 300

#: Tile rows whose sums a task holds.
_SUMS = 64

_BLOCK = "t bigint, data binary"


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _random(spark: SparkSession, n: int, k: int, tile: int, seed: int) -> DataFrame:
    """Blocks (t, data) of ``tile`` rows of k random columns each; a block depends on its number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                x = np.random.default_rng([seed, t]).normal(size=(tile, k))
                x[max(0, n - t * tile) :] = 0
                yield pa.RecordBatch.from_arrays([pa.array([t]), _binary(x)], ["t", "data"])

    return spark.range(-(-n // tile)).mapInArrow(run, _BLOCK)


def _product(matrix: DataFrame, blocks: DataFrame, rows: int, k: int, edges: tuple[int, int], transposed: bool = False) -> DataFrame:
    """The blocks of the matrix (or its transpose) times k vectors of ``rows`` elements in blocks; ``edges`` are a tile's rows and columns.

    A task adds up what belongs to one tile row before it gives it out.
    """
    here, there = ("tj", "ti") if transposed else ("ti", "tj")
    inner, size = edges if transposed else edges[::-1]
    both = matrix.select(F.col(here).alias("here"), F.col(there).alias("t"), F.col("data").alias("cells")).join(sent(blocks, 8 * rows * k), "t").select("here", "cells", "data")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                here, cells, data = (c[at].as_py() for c in batch.columns)
                m = np.frombuffer(cells).reshape(edges)
                part = (m.T if transposed else m) @ np.frombuffer(data).reshape(inner, k)
                sums[here] = sums[here] + part if here in sums else part
                if len(sums) > _SUMS:
                    first = next(iter(sums))
                    yield pa.RecordBatch.from_arrays([pa.array([first]), _binary(sums.pop(first))], ["t", "data"])
        for t, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t]), _binary(x)], ["t", "data"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros((size, k))
        for x in table.column("data"):
            total += np.frombuffer(x.as_py()).reshape(size, k)
        return pa.table({"t": table.column("t")[:1], "data": _binary(total)})

    return dealt(both.mapInArrow(partial, _BLOCK).groupBy("t").applyInArrow(added, _BLOCK))


def _times(blocks: DataFrame, k: int, small: np.ndarray) -> DataFrame:
    """Vectors in blocks times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, data in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([t]), _binary(np.frombuffer(data).reshape(-1, k) @ small)], ["t", "data"])

    return blocks.select("t", "data").mapInArrow(run, _BLOCK)


def _triangle(blocks: DataFrame, widths: list[int]) -> np.ndarray:
    """The triangular factor of vectors in blocks, several binary columns beside each other."""
    n, names = sum(widths), [c for c in blocks.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.hstack([np.frombuffer(x).reshape(-1, w) for x, w in zip(row, widths)])
                offsets = np.arange(0, rows.size + 1, n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], ["row"])

    return tall.triangle(blocks.select(*names).mapInArrow(run, "row array<double>"), n)


def _orthonormal(blocks: DataFrame, k: int, r: np.ndarray) -> tuple[DataFrame, int]:
    """An orthonormal base of what vectors with the factor ``r`` span, and its size; directions below rounding are left out."""
    for last in (False, True):
        _, s, v = np.linalg.svd(r)
        kept = int((s > s.max(initial=0) * k * 64 * np.finfo(float).eps).sum())
        if not kept:
            return blocks, 0
        blocks, k = stored(_times(blocks, k, v[:kept].T / s[:kept]), "base"), kept
        if not last:  # once more, for what rounding left
            r = _triangle(blocks, [k])
    return blocks, k


def _cells(blocks: DataFrame, n: int, k: int, tile: int) -> Array:
    if not k:
        return Array(blocks.sparkSession.createDataFrame([], "i0 bigint, i1 bigint, v double"), (n, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, data in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data).reshape(tile, k)[: n - t * tile]
                i, j = np.meshgrid(np.arange(len(x)) + t * tile, np.arange(k), indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(x.ravel())], ["i0", "i1", "v"])

    return Array(blocks.select("t", "data").mapInArrow(run, "i0 bigint, i1 bigint, v double"), (n, k))


@dataclass(frozen=True)
class Pairs:
    """Values in order, the vectors as columns, and for each the residual against the largest value."""

    values: np.ndarray
    vectors: Array
    residuals: np.ndarray
    left: Array | None = None


def _filled(blocks: DataFrame, n: int, k: int, tile: int) -> DataFrame:
    """Blocks of a product, with those of zeros that no tile gave."""
    every = blocks.sparkSession.range(-(-n // tile)).select(F.col("id").alias("t")).join(blocks, "t", "left").select("t", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, data in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([data or bytes(8 * tile * k)], pa.binary())], ["t", "data"])

    return every.mapInArrow(run, _BLOCK)


def eigh(a: Array, k: int, tile: int = tiles.TILE, tol: float = 1e-9, rounds: int = ROUNDS, seed: int = 0) -> Pairs:
    """The k eigenpairs of largest size of a symmetric matrix, in order of size.

    Pairs of equal size may come in either order, and their vectors as any base of their space.
    """
    return eigh_tiles(stored(tiles.to_tiles(a, tile), "tiles"), a.shape[0], k, tile, tol, rounds, seed)


def eigh_tiles(matrix: DataFrame, n: int, k: int, tile: int, tol: float = 1e-9, rounds: int = ROUNDS, seed: int = 0) -> Pairs:
    """The same of a matrix of tiles, which is read anew in each round: tiles that are cheap to make need no store."""
    spark = matrix.sparkSession
    width = min(n, k + SPARE)
    pair = Alternating(spark, "pair")
    base = stored(_random(spark, n, width, tile, seed), "base")
    base, width = _orthonormal(base, width, _triangle(base, [width]))
    for _ in range(rounds):
        image = _filled(_product(matrix, base, n, width, (tile, tile)), n, width, tile).withColumnRenamed("data", "image")
        both = pair.put(base.join(image, "t"))
        r = _triangle(both, [width, width])
        q, y = r[:, :width], r[:, width:]
        projected = q[:width].T @ y[:width]  # the base is orthonormal
        values, w = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")
        values, w = values[order], w[:, order]
        most = np.abs(values).max(initial=0)
        if not most:
            return Pairs(np.zeros(0), _cells(base, n, 0, tile), np.zeros(0))
        residuals = np.linalg.norm(y @ w - q @ w * values, axis=0)[:k] / most
        if (residuals <= tol).all():
            found = stored(_times(base, width, w[:, :k]), "vectors")
            return Pairs(values[:k], _cells(found, n, min(k, width), tile), residuals)
        image = both.select("t", F.col("image").alias("data"))
        base, width = _orthonormal(image, width, y)
    raise np.linalg.LinAlgError(f"no convergence in {rounds} rounds: residuals up to {residuals.max():.2g}")


def svd(a: Array, k: int, tile: int = tiles.TILE, tol: float = 1e-9, rounds: int = ROUNDS, seed: int = 0) -> Pairs:
    """The k largest singular values of a matrix of any shape with the right (``vectors``) and left (``left``) vectors."""
    (n, m), spark = a.shape, a.df.sparkSession
    width = min(n, m, k + SPARE)
    high, wide = min(tile, n), min(tile, m)  # tiles are no wider than the matrix
    matrix = stored(tiles.to_tiles(a, high, wide), "tiles")
    pair = Alternating(spark, "pair")
    right = stored(_random(spark, m, width, wide, seed), "base")
    right, width = _orthonormal(right, width, _triangle(right, [width]))
    for _ in range(rounds):
        image = stored(_filled(_product(matrix, right, m, width, (high, wide)), n, width, high), "image")
        r = _triangle(image, [width])
        u, s, wt = np.linalg.svd(r)
        most = s.max(initial=0)
        if not most:
            return Pairs(np.zeros(0), _cells(right, m, 0, wide), np.zeros(0), _cells(image, n, 0, high))
        kept = int((s > most * width * 64 * np.finfo(float).eps).sum())
        # a v = s u holds by construction; what is left to see is a' u = s v
        left = stored(_times(image, width, wt[:kept].T / s[:kept]), "left")
        turned = _times(right, width, wt[:kept].T)
        back = _filled(_product(matrix, left, n, kept, (high, wide), True), m, kept, wide).withColumnRenamed("data", "image")
        both = pair.put(turned.join(back, "t"))
        r = _triangle(both, [kept, kept])
        v, z = r[:, :kept], r[:, kept:]
        residuals = np.linalg.norm(z - v * s[:kept], axis=0)[:k] / most
        if (residuals <= tol).all():
            few, some = min(k, kept), np.eye(kept)[:, :k]
            vectors = stored(_times(both.select("t", "data"), kept, some), "vectors")
            lefts = stored(_times(left, kept, some), "vectors")
            return Pairs(s[:few], _cells(vectors, m, few, wide), residuals, _cells(lefts, n, few, high))
        right, width = _orthonormal(both.select("t", F.col("image").alias("data")), kept, z)
    raise np.linalg.LinAlgError(f"no convergence in {rounds} rounds: residuals up to {residuals.max():.2g}")
