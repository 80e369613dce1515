"""Centroid clustering with adaptive lower bounds.

Every vector is stored with the centroid it belongs to, an upper bound of the distance
to it, its next nearest centroids with a lower bound for each, and one lower bound for
all the others. When centroids move, bounds give way by the way moved. A vector whose
upper bound (made exact first) is under all lower bounds stays where it is. Otherwise
the shortest head of its list is compared anew whose remaining bounds are certainly
above; where even the last bound isn't, all centroids are. The list is as long as a
quarter of the centroids at first and shrinks to what a round used, down to an eighth.

Vectors and centroids are whole numbers and distances are compared exactly; bounds are
rounded away from a decision and a tie is never certified, so the assignment is that of
a full comparison with ties going to the smaller number.

A round is one pass over the stored vectors. Its centroids come from the sums of the
round before and the vectors that changed over, added in each task and then by
centroid; at most ``k`` rows of sums reach the driver.

Defined cases: a vector that is null, has another number of components or a null or
non-finite one has no row in the result. A row with a null vec_id is no first
centroid but is assigned. First centroids are rows: repeated ones may be chosen
together, in the order of their components, and then the smaller number wins. With
fewer than ``k`` vectors there are as many centroids; with none, no rows. A component
beyond +-2^27 raises (a distance would not fit 64 bits). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, stored

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Rows compared at a time: a block of distances has a column for each centroid.
BLOCK = 2048
#: Components up to this make distances that doubles hold exactly, and the most a component may be.
EXACT, MOST = 1 << 22, 1 << 27

STATE = "vec_id bigint, x array<int>, prev int, cluster int, upper float, near binary, lower binary, rest float, used int"


def whole_vectors(table: DataFrame, size: int = SIZE, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """vec_id and x, the components as whole numbers, of the rows with a proper vector."""
    vector = F.col(column)
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.cast("array<double>").alias("v")).filter(F.size("v") == size)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    in_range = lambda x: F.when(F.abs(x) > MOST, F.raise_error(F.lit("a component is beyond the range"))).otherwise(x).cast("int")
    return rows.filter(fine).select("vec_id", F.transform("v", lambda x: in_range(F.floor(x * scale))).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of least hash, in that order: a top-k, so a few rows reach the driver."""
    drawn = vectors.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = drawn.orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), len(rows[0].x) if rows else 0)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


class Bounds:
    """Assignment of blocks of vectors to moved centroids."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None, length: int) -> None:
        self.c, self.length = centroids, min(length, len(centroids) - 1)
        self.norms = (centroids * centroids).sum(1)
        self.exact = not len(centroids) or np.abs(centroids).max(initial=0) <= EXACT
        self.real = centroids.astype(np.float64)
        if moved is not None:
            self.moved = np.nextafter(np.nextafter(moved, np.inf), np.inf)
            self.most = self.moved.max(initial=0)

    def to_all(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances to every centroid."""
        if self.exact and np.abs(x).max(initial=0) <= EXACT:  # products and sums stay under 2^53
            cross = (x.astype(np.float64) @ self.real.T).astype(np.int64)
        else:
            cross = x @ self.c.T
        return (x * x).sum(1)[:, None] - 2 * cross + self.norms

    def to_some(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of each row to the centroids in its row of ``which``."""
        return np.stack([((x - self.c[which[:, k]]) ** 2).sum(1) for k in range(which.shape[1])], 1)

    def fresh(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, upper, near, lower, rest, of a full comparison."""
        d, b = self.to_all(x), self.length
        order = np.argsort(d, 1, kind="stable")  # ties: the smaller number
        far = np.sqrt(np.take_along_axis(d, order[:, : b + 2], 1).astype(np.float64))
        rest = _down(far[:, b + 1]) if d.shape[1] > b + 1 else np.full(len(x), np.inf, np.float32)
        return order[:, 0].astype(np.int32), _up(far[:, 0]), order[:, 1 : b + 1].astype(np.uint16), _down(far[:, 1 : b + 1]), rest

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for vectors with bounds, and how much of its list each used."""
        b, n = self.length, len(x)
        if near.shape[1] > b:  # a shorter list: what leaves it joins the others
            rest = np.minimum(rest, lower[:, b:].min(1))
            near, lower = near[:, :b].copy(), lower[:, :b].copy()
        cluster = cluster.copy()
        upper = _up(upper.astype(np.float64) + self.moved[cluster])
        lower = _down(lower.astype(np.float64) - self.moved[near])
        rest = _down(rest.astype(np.float64) - self.most)
        used = np.zeros(n, np.int32)

        def head(rows: np.ndarray) -> np.ndarray:
            """How many of the list must be compared: all bounds from there on are certainly above."""
            bounds = np.concatenate([lower[rows], rest[rows, None]], 1)
            behind = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]
            return (upper[rows, None] >= behind).sum(1)

        open_rows = np.flatnonzero(head(np.arange(n)) > 0)
        if len(open_rows):
            exact = ((x[open_rows] - self.c[cluster[open_rows]]) ** 2).sum(1)
            upper[open_rows] = _up(np.sqrt(exact.astype(np.float64)))
            need = head(open_rows)
            for z in np.unique(need[need > 0]).tolist():
                rows = open_rows[need == z]
                used[rows] = z
                if z > b:
                    cluster[rows], upper[rows], near[rows], lower[rows], rest[rows] = self.fresh(x[rows])
                    continue
                which = np.concatenate([cluster[rows, None], near[rows, :z].astype(np.int32)], 1)
                d = self.to_some(x[rows], which)
                order = np.lexsort((which, d), axis=1)
                which, far = np.take_along_axis(which, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
                cluster[rows], upper[rows] = which[:, 0], _up(far[:, 0])
                near[rows, :z], lower[rows, :z] = which[:, 1:], _down(far[:, 1:])
        return cluster, upper, near, lower, rest, used


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _unpacked(column: pa.Array, kind: type, n: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data.reshape(n, -1).copy()


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, length: int) -> DataFrame:
    """The state of every vector after an assignment; ``state`` has vec_id and x only where ``moved`` is None."""
    schema = arrow_schema(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(centroids, moved, length)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, n = _rows(part["x"], centroids.shape[1]), part.num_rows
                if moved is None:
                    prev = np.full(n, -1, np.int32)
                    cluster, upper, near, lower, rest = bounds.fresh(x)
                    used = np.zeros(n, np.int32)
                else:
                    prev, upper, rest = (part[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "rest"))
                    near, lower = _unpacked(part["near"], np.uint16, n), _unpacked(part["lower"], np.float32, n)
                    cluster, upper, near, lower, rest, used = bounds.again(x, prev, upper, near, lower, rest)
                out = [part["vec_id"], part["x"], prev, cluster, upper, _packed(near), _packed(lower), rest, used]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], schema=schema)

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the counts and sums of the centroids differ from the round before."""
    ddl = "cluster int, n bigint, " + ", ".join(f"s{j} bigint" for j in range(size))
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.concatenate([np.ones((part.num_rows, 1), np.int64), _rows(part["x"], size)], 1)
                for name, sign in (("cluster", 1), ("prev", -1)):
                    which = part[name].to_numpy(zero_copy_only=False)
                    order = np.argsort(which, kind="stable")
                    order = order[which[order] >= 0]
                    if len(order):
                        keys, starts = np.unique(which[order], return_index=True)
                        total[keys] += sign * np.add.reduceat(x[order], starts, 0)
        some = np.flatnonzero(total.any(1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, j]) for j in range(size + 1))], schema=schema)

    moved = state.filter("cluster <> prev").select("x", "prev", "cluster").mapInArrow(run, ddl)
    sums = moved.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(size)))
    counts, totals = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for r in sums.collect():
        counts[r[0]], totals[r[0]] = r[1], r[2:]
    return counts, totals


def cluster_vectors(table: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x and cluster of every proper vector after ``rounds`` rounds and a last assignment, and the final centroids."""
    vectors = stored(whole_vectors(table, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        if not vectors.isEmpty():
            raise ValueError("no vector has a vec_id, so there is no first centroid")
        return vectors.withColumn("cluster", F.lit(0)), centroids
    k = len(centroids)
    length, least = max(1, k // 4), max(1, k // 8)
    counts, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
    state, moved = vectors, None
    for r in range(rounds + 1):
        state = stored(assign(state, centroids, moved, length), f"assigned-{r}")
        if r == rounds:
            break
        n, total = changes(state, k, size)
        counts, sums = counts + n, sums + total
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        moved = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64))
        centroids = new
        if r:  # a row that compared all centroids says nothing of the list's length
            most = state.filter(F.col("used") <= min(length, k - 1)).agg(F.max("used")).first()[0] or 0
            length = min(length, max(least, most))
    return state.select("vec_id", "x", "cluster"), centroids


def clustered(table: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every proper vector."""
    state, centroids = cluster_vectors(table, k, rounds, size, scale, seed)
    if not len(centroids):
        return state.selectExpr("vec_id", "cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    spark = table.sparkSession
    named = [(j, [int(v) for v in c], hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    final = F.broadcast(spark.createDataFrame(named, "cluster int, c array<bigint>, centroid_sha256 string"))  # k rows
    squares = F.zip_with("x", "c", lambda a, b: (a - b) * (a - b))
    far = state.join(final, "cluster").select("vec_id", "cluster", F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("distance"), "centroid_sha256")
    # k rows of inertia, added again for the whole
    parts = stored(far.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint").alias("cluster_inertia")), "inertia")
    whole = parts.agg(F.sum("cluster_inertia")).first()[0] or 0
    out = far.join(F.broadcast(parts), "cluster").withColumn("inertia", F.lit(whole).cast("bigint"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
