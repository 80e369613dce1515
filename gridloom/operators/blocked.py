"""Factorisations of large square matrices, as steps over tiles.

Each step takes one column of tiles, finds its pivots, and updates all tiles to the
right of it by the column's multipliers (by tile row) and the pivot rows (by tile
column). Both are stored in blocks, and a task reads the blocks that its tiles need,
so the matrix itself is never shuffled. A step's matrix is written to the shared
folder, in two places by turns, so the plan stays one step long and no more than two
copies are kept, besides the pivot rows where they are wanted: ``solve`` and ``inv``
substitute them backwards, one step more for each column of tiles. A folder has one
column of tiles, files of ``FILE`` bytes of elements, as a reader may hold a whole file.

Tiles and blocks are packed (``tiles.packed``): a zero one costs nothing, and one that
compresses is short in plans, shuffles and files. Zero multipliers or pivot rows leave
a tile as it is. Triangles are substituted without exchanges of rows, so zeros that
exact arithmetic gives are not lost to rounding.

Pivot rows are found by a tournament: every tile of the column elects its own, and
the elected are set against each other, ``FAN`` tiles at a time. Rows are never moved;
the order of the pivots (a whole number for each row of the matrix) is all that the
driver keeps, besides one tile at a time.

An empty matrix isn't taken; elements that lack are zero; a singular matrix raises
``LinAlgError`` (its determinant is 0).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array
from ..sources.ranges import file_system
from ..storage import Alternating, dealt, parted, shared_dir
from . import tiles

#: Elements along an edge, and tiles whose elected rows meet in a round of the tournament.
TILE, FAN = 512, 8
#: Bytes of tiles in a file and in a task that makes tiles, columns that are eliminated at a time inside a block, blocks that a task keeps.
FILE, MADE, STRIP, KEPT = 8 << 20, 64 << 20, 64, 4
#: Steps over which tiles grow, and the edge up to which they do.
STEPS, MOST = 16, 1024

_TILE = "ti bigint, tj bigint, data binary"
_BLOCK = "tj bigint, rows bigint, data binary"
_ELECTED = "part bigint, ids binary, data binary"


def edge(n: int, tile: int = TILE) -> int:
    """The edge of tiles for a matrix of side n: every step writes the matrix, so a large one takes larger tiles."""
    while tile < MOST and n > STEPS * tile:
        tile *= 2
    return tile


def _square(a: Array) -> int:
    if a.ndim != 2 or a.shape[0] != a.shape[1] or not a.shape[0]:
        raise np.linalg.LinAlgError(f"{a.shape} is no square matrix")
    return a.shape[0]


def _per_row(names: list[str], f: Callable[..., tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a row of tiles, for ``mapInArrow``; one row's result is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = f(*(c[k].as_py() for c in batch.columns))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in out], names)

    return run


def _blocks(path: str, cols: int) -> Callable[[str], np.ndarray | None]:
    """Reads the block of a folder (``ti=1``) of ``parted``, in a task; None (that is zero) where there is none. The last ones stay."""
    kept: dict[str, np.ndarray | None] = {}
    known: list = []

    def block(k: str) -> np.ndarray | None:
        if k not in kept:
            if not known:
                known.extend(file_system(path))
                if known[0].get_file_info(known[1]).type != fs.FileType.Directory:
                    raise FileNotFoundError(f"{path} isn't shared by driver and executors")
            if len(kept) >= KEPT:
                kept.pop(next(iter(kept)))
            at = f"{known[1]}/{k}"
            there = known[0].get_file_info(at).type != fs.FileType.NotFound
            row = parquet.read_table(at, columns=["rows", "data"], filesystem=known[0], use_threads=False, partitioning=None).to_pylist()[0] if there else None
            kept[k] = tiles.unpacked(row["data"], row["rows"], cols) if row else None
        return kept[k]

    return block


def places(spark: SparkSession, rows: int, cols: int, tile: int) -> DataFrame:
    """The (ti, tj) of all tiles, column after column, in parts of a bounded number."""
    parts = max(spark.sparkContext.defaultParallelism, -(-8 * tile * tile * rows * cols // MADE))
    return spark.range(0, rows * cols, 1, parts).select((F.col("id") % rows).alias("ti"), F.floor(F.col("id") / rows).alias("tj"))


def _complete(found: DataFrame, rows: int, cols: int, tile: int, lower: bool = False) -> DataFrame:
    """All tiles of a matrix (or those on and below the diagonal); a lacking one is zero."""
    at = places(found.sparkSession, rows, cols, tile)
    at = at.filter("ti >= tj") if lower else at
    return at.join(dealt(found), ["ti", "tj"], "left").select("ti", "tj", F.coalesce("data", F.lit(b"")).alias("data"))


def _factor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by partial pivoting, multipliers and upper factor in one array), a strip of columns at a time."""
    now, order = x.copy(), np.arange(len(x))
    for first in range(0, min(x.shape), STRIP):
        strip = np.ascontiguousarray(now[first:, first : first + STRIP].T)  # a row for each column: those are long
        swaps = np.arange(len(now) - first)
        for k in range(min(strip.shape)):
            best = k + int(np.argmax(np.abs(strip[k, k:])))
            if best != k:
                strip[:, [k, best]], swaps[[k, best]] = strip[:, [best, k]], swaps[[best, k]]
            if strip[k, k]:
                strip[k, k + 1 :] /= strip[k, k]
                strip[k + 1 :, k + 1 :] -= np.outer(strip[k + 1 :, k], strip[k, k + 1 :])
        order[first:], now[first:] = order[first:][swaps], now[first:][swaps]
        now[first:, first : first + STRIP] = strip.T
        last = first + min(strip.shape)
        if last == first + STRIP < x.shape[1]:
            now[first:last, last:] = _forward(now[first:last, first:last], now[first:last, last:])
            now[last:, last:] -= now[last:, first:last] @ now[first:last, last:]
        elif last < x.shape[1]:  # fewer rows than columns
            now[first:last, first + STRIP :] = _forward(now[first:last, first:last], now[first:last, first + STRIP :])
    return order, now


def _forward(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Solves l x = rows for the multipliers of a square factor; the ones of its diagonal are no less than they, so no rows are exchanged."""
    return np.linalg.solve(np.tril(factor, -1) + np.eye(len(factor)), rows)


def _across(factor: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solves l u = x for the upper part of a square factor, turned about so that its triangle stays an upper one."""
    return np.linalg.solve(np.triu(factor).T[::-1, ::-1], x.T[::-1])[::-1].T


def _elect(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that partial pivoting puts first, in their order, as many as there are columns."""
    won = _factor(x)[0][: x.shape[1]]
    return ids[won], x[won]


def _tournament(column: DataFrame, free: np.ndarray, width: int, tile: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their elements in the column of tiles), ``width`` of them (fewer: the rest are zero), among the free rows."""

    def own(ti: int, data: bytes) -> tuple | None:
        rows = np.flatnonzero(free[ti * tile : (ti + 1) * tile])
        if not len(rows) or not data:
            return None
        ids, x = _elect(rows + ti * tile, tiles.unpacked(data, tile, tile)[rows, :width])
        return ti // FAN, ids.tobytes(), tiles.packed(x)

    def meet(table: pa.Table) -> pa.Table:
        every = [np.frombuffer(x.as_py(), np.int64) for x in table.column("ids")]
        ids, x = np.concatenate(every), np.concatenate([tiles.unpacked(x.as_py(), len(k), width) for k, x in zip(every, table.column("data"))])
        order = np.argsort(ids)  # the same result whatever order rows arrive in
        ids, x = _elect(ids[order], x[order])
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([tiles.packed(x)], pa.binary())})

    elected = column.select("ti", "data").mapInArrow(_per_row(["part", "ids", "data"], own), _ELECTED)
    parts = -(-count // FAN)
    while True:
        elected = elected.groupBy("part").applyInArrow(meet, _ELECTED)
        if parts == 1:
            break
        parts = -(-parts // FAN)
    found = elected.collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, width))
    ids = np.frombuffer(found[0]["ids"], np.int64)
    return ids, tiles.unpacked(bytes(found[0]["data"]), len(ids), width)


def _eliminated(now: DataFrame, n: int, cols: int, tile: int, kept: str | None = None) -> tuple[np.ndarray, float, float]:
    """(pivot rows in order, sign, logarithm of the determinant's size) of n x n tiles with right sides beside them, ``cols`` tiles in all.

    ``kept`` is a folder for the upper factor and what becomes of the right sides: their blocks by (ti, tj).
    """
    spark, count, rows = now.sparkSession, -(-n // tile), max(1, FILE // (8 * tile * tile))
    turns, panels = Alternating(spark, "elimination"), f"{shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    now, free, order, sign, log = turns.put(now, "tj", rows), np.ones(n, bool), [], 1.0, 0.0
    for k in range(count):
        width = min(tile, n - k * tile)
        pivots, block = _tournament(now.filter(F.col("tj") == k), free, width, tile, count)
        if len(pivots) < width:
            return np.array([]), 0.0, -math.inf
        at, factor = _factor(block)
        pivots, steps = pivots[at], np.diag(factor)
        if not steps.all():
            return np.array([]), 0.0, -math.inf
        sign, log = sign * np.prod(np.sign(steps)), log + np.log(np.abs(steps)).sum()
        order.append(pivots)
        free[pivots] = False
        if k + 1 < cols:
            upper = f"{kept}/ti={k}" if kept else f"{panels}-upper"
            _pivot_rows(now, k, pivots, factor, tile, upper)
        if k + 1 < count:
            now = turns.put(_step(now, k, factor, free, tile, upper, f"{panels}-lower"), "tj", rows)
    return np.concatenate(order), sign, log


def _pivot_rows(now: DataFrame, k: int, pivots: np.ndarray, factor: np.ndarray, tile: int, path: str) -> None:
    """Store the blocks of the upper factor that a step's pivot rows make, the one on the diagonal included."""
    width = len(pivots)

    def taken(ti: int, tj: int, data: bytes) -> tuple | None:
        at = np.flatnonzero(pivots // tile == ti)
        x = tiles.unpacked(data, tile, tile)[pivots[at] - ti * tile]
        return (tj, at.astype(np.int64).tobytes(), tiles.packed(x)) if x.any() else None

    def solved(table: pa.Table) -> pa.Table:
        rows = np.zeros((width, tile))
        for at, data in zip(table.column("at"), table.column("data")):
            at = np.frombuffer(at.as_py(), np.int64)
            rows[at] = tiles.unpacked(data.as_py(), len(at), tile)
        return pa.table({"tj": table.column("tj")[:1], "rows": pa.array([width]), "data": pa.array([tiles.packed(_forward(factor, rows))], pa.binary())})

    held = now.filter((F.col("tj") > k) & F.col("ti").isin(np.unique(pivots // tile).tolist()))
    held = held.select("ti", "tj", "data").mapInArrow(_per_row(["tj", "at", "data"], taken), "tj bigint, at binary, data binary")
    corner = np.zeros((width, tile))
    corner[:, :width] = np.triu(factor)
    own = now.sparkSession.createDataFrame([(k, width, bytearray(tiles.packed(corner)))], _BLOCK)
    parted(held.groupBy("tj").applyInArrow(solved, _BLOCK).unionByName(own), path, "tj")


def _step(now: DataFrame, k: int, factor: np.ndarray, free: np.ndarray, tile: int, upper: str, lower: str) -> DataFrame:
    """The tiles right of column k, less the multipliers of their rows times the pivot rows; those without a free row are dropped."""
    width = len(factor)

    def used(ti: int) -> np.ndarray:
        return np.flatnonzero(~free[ti * tile : (ti + 1) * tile])

    def multipliers(ti: int, data: bytes) -> tuple | None:
        x = tiles.unpacked(data, tile, tile)[:, :width].copy()
        x[used(ti)] = 0
        return (ti, tile, tiles.packed(_across(factor, x))) if x.any() else None

    left = F.col("ti").isin(np.unique(np.flatnonzero(free) // tile).tolist())
    column = now.filter((F.col("tj") == k) & left).select("ti", "data")
    parted(column.mapInArrow(_per_row(["ti", "rows", "data"], multipliers), "ti bigint, rows bigint, data binary"), lower, "ti")
    by_row, by_column = _blocks(lower, width), _blocks(upper, tile)

    def updated(ti: int, tj: int, data: bytes) -> tuple:
        x = by_row(f"ti={ti}")
        y = by_column(f"tj={tj}") if x is not None else None
        return (ti, tj, data) if y is None else (ti, tj, tiles.packed(tiles.unpacked(data, tile, tile) - x @ y))

    return now.filter((F.col("tj") > k) & left).select("ti", "tj", "data").mapInArrow(_per_row(["ti", "tj", "data"], updated), _TILE)


def _solved(every: DataFrame, n: int, m: int, tile: int) -> Array:
    """The solutions for all tiles of a matrix with its right sides beside it: eliminated, then substituted backwards."""
    spark, count, more, rows = every.sparkSession, -(-n // tile), -(-m // tile), max(1, FILE // (8 * tile * tile))
    kept, path = (f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("upper", "solved"))
    _, sign, _ = _eliminated(every, n, count + more, tile, kept)
    if not sign:
        raise np.linalg.LinAlgError("Singular matrix")
    turns, block = Alternating(spark, "substitution"), _blocks(kept, tile)
    now = spark.read.schema(_TILE).parquet(kept).filter(F.col("tj") >= count)
    now = _filled(now.withColumn("tj", F.col("tj") - count), count, more, tile)
    for k in reversed(range(count)):
        width = min(tile, n - k * tile)
        corner = block(f"ti={k}/tj={k}")[:, :width]

        def solved(tj: int, data: bytes) -> tuple | None:
            if not data:
                return None
            out = np.zeros((tile, tile))
            out[:width] = np.linalg.solve(corner, tiles.unpacked(data, width, tile))
            return tj, tile, tiles.packed(out)

        # a step's solutions have their own folder, so that a repeated write replaces it
        parted(now.filter(F.col("ti") == k).select("tj", "data").mapInArrow(_per_row(["tj", "rows", "data"], solved), _BLOCK), f"{path}/ti={k}", "tj")
        if not k:
            break
        upper, found = _blocks(kept, tile), _blocks(f"{path}/ti={k}", tile)

        def updated(ti: int, tj: int, data: bytes) -> tuple:
            y = found(f"tj={tj}")
            x = upper(f"ti={ti}/tj={k}") if y is not None else None
            return (ti, tj, data) if x is None else (ti, tj, tiles.packed(tiles.unpacked(data, tile, tile) - x[:, :width] @ y[:width]))

        now = turns.put(now.filter(F.col("ti") < k).select("ti", "tj", "data").mapInArrow(_per_row(["ti", "tj", "data"], updated), _TILE), "ti", rows)
    return tiles.from_tiles(_filled(spark.read.schema(_TILE).parquet(path), count, more, tile), (n, m), tile)


def _filled(found: DataFrame, rows: int, cols: int, tile: int) -> DataFrame:
    """Stored blocks and, where there are none, tiles without bytes; only the places of the blocks are sent."""
    lacking = places(found.sparkSession, rows, cols, tile).join(F.broadcast(found.select("ti", "tj")), ["ti", "tj"], "left_anti")
    return found.select("ti", "tj", "data").unionByName(lacking.withColumn("data", F.lit(b"")))


def solve_tiles(matrix: DataFrame, b: Array, tile: int) -> Array:
    """x of a x = b, for all tiles of a (lacking ones not allowed) and one right side (1-D) or several (2-D)."""
    n, m = b.shape[0], b.shape[1] if b.ndim == 2 else 1
    wide = b.df if b.ndim == 2 else b.df.select("i0", F.lit(0).cast("bigint").alias("i1"), "v")
    count = -(-n // tile)
    sides = _complete(tiles.to_tiles(Array(wide, (n, m)), tile), count, -(-m // tile), tile).withColumn("tj", F.col("tj") + count)
    out = _solved(matrix.select("ti", "tj", "data").unionByName(sides), n, m, tile)
    return out if b.ndim == 2 else Array(out.df.select("i0", "v"), (n,))


def solve(a: Array, b: Array, tile: int | None = None) -> Array:
    """x of a x = b, for one right side (1-D) or several (2-D), by blocked elimination with pivots."""
    n = _square(a)
    if b.shape[0] != n:
        raise ValueError(f"{a.shape} and {b.shape} have other numbers of rows")
    tile = tile or edge(n)
    count = -(-n // tile)
    return solve_tiles(_complete(tiles.to_tiles(a, tile), count, count, tile), b, tile)


def inv_tiles(matrix: DataFrame, n: int, tile: int) -> Array:
    """The inverse, for all tiles of a matrix (lacking ones not allowed)."""
    count = -(-n // tile)

    def ones(ti: int, tj: int) -> tuple:
        return ti, tj + count, tiles.packed(np.diag((np.arange(tile) + ti * tile < n).astype(float))) if ti == tj else b""

    sides = places(matrix.sparkSession, count, count, tile).mapInArrow(_per_row(["ti", "tj", "data"], ones), _TILE)
    return _solved(matrix.select("ti", "tj", "data").unionByName(sides), n, n, tile)


def inv(a: Array, tile: int | None = None) -> Array:
    n = _square(a)
    tile = tile or edge(n)
    count = -(-n // tile)
    return inv_tiles(_complete(tiles.to_tiles(a, tile), count, count, tile), n, tile)


def slogdet_tiles(matrix: DataFrame, n: int, tile: int) -> tuple[float, float]:
    """(sign, logarithm of the size) of the determinant, for all tiles of a matrix (lacking ones not allowed)."""
    order, sign, log = _eliminated(matrix.select("ti", "tj", "data"), n, -(-n // tile), tile)
    seen, cycles = np.zeros(len(order), bool), 0
    for k in range(len(order)):
        cycles += not seen[k]
        while not seen[k]:
            seen[k], k = True, order[k]
    return float(-sign if (len(order) - cycles) % 2 else sign), float(log)


def slogdet(a: Array, tile: int | None = None) -> tuple[float, float]:
    """(sign, logarithm of the size) of the determinant."""
    n = _square(a)
    tile = tile or edge(n)
    count = -(-n // tile)
    return slogdet_tiles(_complete(tiles.to_tiles(a, tile), count, count, tile), n, tile)


def det(a: Array, tile: int | None = None) -> float:
    sign, log = slogdet(a, tile)
    return sign * math.exp(log) if sign else 0.0


def cholesky_tiles(matrix: DataFrame, n: int, tile: int) -> Array:
    """The lower factor of a positive definite matrix, for all its tiles on and below the diagonal."""
    spark, count, rows = matrix.sparkSession, -(-n // tile), max(1, FILE // (8 * tile * tile))
    path, turns = f"{shared_dir(spark)}/factor-{uuid.uuid4().hex}", Alternating(spark, "cholesky")
    now = turns.put(matrix.select("ti", "tj", "data"), "tj", rows)
    for k in range(count):
        width = min(tile, n - k * tile)
        corner = tiles.unpacked(bytes(now.filter((F.col("ti") == k) & (F.col("tj") == k)).collect()[0]["data"]), tile, tile)
        top = np.linalg.cholesky(corner[:width, :width])

        def divided(ti: int, data: bytes) -> tuple | None:
            if not data:
                return None
            out = np.zeros((tile, tile))
            out[:, :width] = np.linalg.solve(top, tiles.unpacked(data, tile, tile)[:, :width].T).T
            if ti == k:
                out[:width, :width], out[width:] = top, 0
            return ti, tile, tiles.packed(out)

        # a step's panel has its own folder, so that a repeated write replaces it
        parted(now.filter(F.col("tj") == k).select("ti", "data").mapInArrow(_per_row(["ti", "rows", "data"], divided), "ti bigint, rows bigint, data binary"), f"{path}/tj={k}", "ti")
        if k + 1 == count:
            break
        panel = _blocks(f"{path}/tj={k}", tile)

        def updated(ti: int, tj: int, data: bytes) -> tuple:
            y, z = panel(f"ti={ti}"), panel(f"ti={tj}")
            if y is None or z is None:
                return ti, tj, data
            return ti, tj, tiles.packed(tiles.unpacked(data, tile, tile) - y[:, :width] @ z[:, :width].T)

        now = turns.put(now.filter(F.col("tj") > k).select("ti", "tj", "data").mapInArrow(_per_row(["ti", "tj", "data"], updated), _TILE), "tj", rows)
    return tiles.from_tiles(_filled(spark.read.schema(_TILE).parquet(path), count, count, tile), (n, n), tile)


def cholesky(a: Array, tile: int | None = None) -> Array:
    """The lower factor of a positive definite matrix; only its lower half is read."""
    n = _square(a)
    tile = tile or edge(n)
    count, half = -(-n // tile), Array(a.df.filter("i0 >= i1"), a.shape)
    return cholesky_tiles(_complete(tiles.to_tiles(half, tile), count, count, tile, lower=True), n, tile)
