"""Tall matrices by a reduction tree of small triangular factors (no Gram matrix, so
the condition number is not squared).

A matrix row is a row with an array column. Every task reduces its rows, some at a
time, to one triangular factor; factors are stacked and reduced again, ``FAN`` at a
time, until one is left. Right sides go along as further columns, so that least squares
need no orthogonal factor at all. Where that is wanted, it is the rows solved against
the triangle, twice (the second time takes out what rounding left in the first).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..arrays import Array
from ..functions.core import real

#: Factors reduced together, and rows of a matrix taken at a time.
FAN, ROWS = 16, 4096

_FACTOR = "part bigint, k int, r array<double>"


def _triangle(x: np.ndarray) -> np.ndarray:
    """The triangular factor with a diagonal that isn't negative, as many rows as columns."""
    n = x.shape[1]
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((n - len(r), n))]) if len(r) < n else r
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _dense(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _as_rows(part: int, r: np.ndarray) -> list[pa.Array]:
    return [pa.array([part] * len(r), pa.int64()), pa.array(range(len(r)), pa.int32()), pa.array(r.tolist(), pa.list_(pa.float64()))]


def triangle(rows: DataFrame, n: int, column: str = "row") -> np.ndarray:
    """The n x n triangular factor of the matrix whose rows are the arrays in ``column``."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = np.zeros((0, n))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                now = _triangle(np.vstack([now, _dense(batch.column(0).slice(at, ROWS), n)]))
        if len(now):
            yield pa.RecordBatch.from_arrays(_as_rows(TaskContext.get().partitionId(), now), ["part", "k", "r"])

    def reduce_factors(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() // FAN
        return pa.Table.from_arrays(_as_rows(part, _triangle(_dense(table.column("r").combine_chunks(), n))), ["part", "k", "r"])

    factors, parts = rows.select(F.col(column).cast("array<double>")).mapInArrow(reduce_rows, _FACTOR), rows.rdd.getNumPartitions()
    while parts > 1:
        factors = factors.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(reduce_factors, _FACTOR)
        parts = -(-parts // FAN)
    out = np.zeros((n, n))
    for _, k, r in factors.collect():  # n rows
        out[k] = r
    return out


def matrix_rows(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """A row per row of ``df``, the columns as an array named ``row``; rows with a null are left out."""
    row = F.array(*(real(c) for c in columns))
    return df.select(row.alias("row")).filter(~F.exists("row", lambda x: x.isNull()))


def array_rows(a: Array) -> DataFrame:
    """i0 and row (the elements of a matrix row, in order), of a matrix in long form."""
    packed = F.array_sort(F.collect_list(F.struct("i1", F.col("v").cast("double").alias("v"))))
    return a.df.groupBy("i0").agg(F.transform(packed, lambda x: x["v"]).alias("row"))


def solve_least_squares(r: np.ndarray, n: int, rcond: float | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(solutions, residual sums of squares, rank, singular values) from the factor of a matrix with its right sides."""
    x, _, rank, s = np.linalg.lstsq(r[:n, :n], r[:n, n:], rcond=rcond)
    inside = r[:n, n:] - r[:n, :n] @ x
    return x, (r[n:, n:] ** 2).sum(0) + (inside**2).sum(0), int(rank), s


def lstsq_columns(df: DataFrame, xs: Sequence[str | Column], ys: Sequence[str | Column], rcond: float | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Least squares of several right sides on columns."""
    n = len(xs)
    return solve_least_squares(triangle(matrix_rows(df, [*xs, *ys]), n + len(ys)), n, rcond)


def lstsq(a: Array, b: Array, rcond: float | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Least squares of a tall matrix with one right side (1-D) or several (2-D), as arrays do: x, residuals, rank, singular values."""
    if a.shape[0] != b.shape[0]:
        raise ValueError(f"{a.shape} and {b.shape} have other numbers of rows")
    right = b if b.ndim == 2 else Array(b.df.select("i0", F.lit(0).cast("bigint").alias("i1"), "v"), (b.shape[0], 1))
    wide = Array(a.df.select("i0", "i1", F.col("v").cast("double").alias("v")).unionByName(right.df.select("i0", (F.col("i1") + a.shape[1]).alias("i1"), F.col("v").cast("double").alias("v"))), (a.shape[0], a.shape[1] + right.shape[1]))
    x, residuals, rank, s = solve_least_squares(triangle(array_rows(wide), wide.shape[1]), a.shape[1], rcond)
    full = rank == a.shape[1] and a.shape[0] > a.shape[1]
    return (x if b.ndim == 2 else x[:, 0]), residuals if full else np.zeros(0), rank, s


def qr(a: Array) -> tuple[Array, np.ndarray]:
    """(Q, R) of a tall matrix of full rank; R is small and has a diagonal above zero."""
    n = a.shape[1]
    rows, total = array_rows(a), np.eye(n)
    for _ in range(2):
        r = triangle(rows, n)
        if not np.diag(r).all():
            raise np.linalg.LinAlgError("the matrix has no full rank")
        rows, total = _solved(rows, r), r @ total
    cells = rows.select("i0", F.posexplode("row").alias("i1", "v"))
    return Array(cells.select("i0", F.col("i1").cast("bigint").alias("i1"), "v"), a.shape), total


def _solved(rows: DataFrame, r: np.ndarray) -> DataFrame:
    """Each row times the inverse of a triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = np.linalg.solve(r.T, _dense(batch.column(1), len(r)).T).T
                offsets = np.arange(0, out.size + 1, len(r), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["i0", "row"])

    return rows.select("i0", "row").mapInArrow(run, "i0 bigint, row array<double>")


def svdvals(a: Array) -> np.ndarray:
    """Singular values of a tall matrix, to the precision of the whole matrix."""
    return np.linalg.svd(triangle(array_rows(a), a.shape[1]), compute_uv=False)


def cond(a: Array) -> float:
    s = svdvals(a)
    return float(s[0] / s[-1]) if s[-1] else float("inf")


def matrix_rank(a: Array) -> int:
    """Singular values above the largest times the longer side times machine precision."""
    s = svdvals(a)
    return int((s > s.max(initial=0) * max(a.shape) * np.finfo(float).eps).sum())
