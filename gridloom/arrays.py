"""The long form of an array: a row per element.

An :class:`Array` is a DataFrame with index columns ``i0 .. i{n-1}`` and a value
column ``v``, and the shape as driver metadata. Changing shape, axes or order is a
projection of index columns; nothing is moved until a join or an aggregation asks
for it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def axis_name(k: int) -> str:
    return f"i{k}"


@dataclass(frozen=True)
class Array:
    df: DataFrame
    shape: tuple[int, ...]

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return [axis_name(k) for k in range(self.ndim)]

    @property
    def dtype(self) -> str:
        return dict(self.df.dtypes)["v"]

    def axis(self, k: int) -> int:
        if not -self.ndim <= k < self.ndim:
            raise ValueError(f"axis {k} is out of bounds for {self.ndim} dimensions")
        return k % self.ndim

    def flat(self) -> Column:
        """The row-major position."""
        out = F.lit(0).cast("bigint")
        for k, n in enumerate(self.shape):
            out = out * n + F.col(axis_name(k))
        return out

    def over(self, axis: int) -> Any:
        """A window along an axis, for every lane."""
        axis = self.axis(axis)
        return Window.partitionBy(*(a for k, a in enumerate(self.axes) if k != axis)).orderBy(axis_name(axis))

    def map(self, f) -> Array:
        """Apply a Column function to the values."""
        return Array(self.df.withColumn("v", f(F.col("v"))), self.shape)

    def relabel(self, columns: dict[str, Column], shape: Sequence[int]) -> Array:
        """New index columns, in order of axes, beside the values."""
        return Array(self.df.select(*(columns[axis_name(k)].cast("bigint").alias(axis_name(k)) for k in range(len(shape))), "v"), tuple(shape))

    def collect(self) -> Any:
        """A NumPy array (for small results and tests)."""
        import numpy as np

        rows = self.df.collect()
        complex_ = bool(rows) and hasattr(rows[0]["v"], "asDict")
        out = np.zeros(self.shape, complex if complex_ else object if rows and isinstance(rows[0]["v"], str) else type(rows[0]["v"]) if rows else float)
        for r in rows:
            out[tuple(r[a] for a in self.axes)] = complex(r["v"]["re"], r["v"]["im"]) if complex_ else r["v"]
        return out


def unravel(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Index columns of a row-major position."""
    out, step = [], math.prod(shape)
    for n in shape:
        step = step // n if n else 1
        out.append(F.pmod(F.floor(flat / step) if step > 1 else flat, F.lit(max(1, n))).cast("bigint"))
    return out


def grid(spark: SparkSession, shape: Sequence[int]) -> Array:
    """All index tuples of a shape; the value is the row-major position."""
    shape = tuple(int(n) for n in shape)
    flat = spark.range(math.prod(shape)).select(F.col("id").alias("v"))
    return Array(flat.select(*(c.alias(axis_name(k)) for k, c in enumerate(unravel(F.col("v"), shape))), "v"), shape)


def from_function(spark: SparkSession, shape: Sequence[int], f) -> Array:
    """f(i0, i1, ...) as a Column over the grid."""
    g = grid(spark, shape)
    return Array(g.df.withColumn("v", f(*(F.col(a) for a in g.axes))), g.shape)


def array(spark: SparkSession, values: Any) -> Array:
    """From nested lists or a NumPy array (small data)."""
    import numpy as np

    values = np.asarray(values)
    if values.dtype.kind == "c":
        rows = [(*map(int, at), (float(v.real), float(v.imag))) for at, v in np.ndenumerate(values)]
        kind = "struct<re:double,im:double>"
    else:
        kind = {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "U": "string", "M": "timestamp"}[values.dtype.kind]
        rows = [(*map(int, at), v.item()) for at, v in np.ndenumerate(values)]
    ddl = ", ".join([*(f"{axis_name(k)} bigint" for k in range(values.ndim)), f"v {kind}"])
    return Array(spark.createDataFrame(rows, ddl), values.shape)


asarray = array


def from_column(df: DataFrame, value: str | Column, order: Sequence[str | Column]) -> Array:
    """A 1-D array from a column; positions follow ``order``, computed without a global sort in one task.

    Rows are range-partitioned; each partition's offset is the number of rows before it.
    """
    value = F.col(value) if isinstance(value, str) else value
    ranged = df.select(value.alias("v"), *(F.col(o).alias(f"__o{k}") if isinstance(o, str) else o.alias(f"__o{k}") for k, o in enumerate(order)))
    keys = [f"__o{k}" for k in range(len(order))]
    numbered = number_rows(ranged, keys, "i0")
    return Array(numbered.select("i0", "v"), (df.count(),))


def number_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A dense 0-based ``name`` in the order of ``keys``, in three parallel steps.

    The rows are dealt by range; a rank within each range is added to the number of
    rows in the ranges before it, a table with one row for each partition.
    """
    from .operators.windows import running_total  # the same two-level scheme

    return running_total(df, keys, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) - 1)


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
