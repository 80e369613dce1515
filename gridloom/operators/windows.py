"""Cumulative and lag-style operators.

Lanes of an n-d array are windows partitioned by the other axes. A single long lane
would put every row in one task, so running totals over a whole DataFrame use two
levels: rows are dealt by range of the order keys and stored with the number of their
part, totals run within a part, and the sums of the parts before it (one row for each
part) are added. Rows and sums are both read from that table: dealt twice, by bounds
that Spark samples anew, they would not agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..arrays import Array, axis_name, concat_frames
from ..storage import stored

_PART, _SUM, _BEFORE = "__gl_part", "__gl_sum", "__gl_before"


def running_total(df: DataFrame, keys: Sequence[str], value: Column, name: str, partitions: int | None = None, product: bool = False) -> DataFrame:
    """``df`` with the running sum (or product) of ``value`` in the order of ``keys`` as ``name``."""
    fold, unit = (F.product, F.lit(1.0)) if product else (F.sum, F.lit(0))
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt = stored(ranged.withColumn(_PART, F.spark_partition_id()), "dealt")
    inner = Window.partitionBy(_PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn(_SUM, fold(value).over(inner))
    totals = dealt.groupBy(_PART).agg(fold(value).alias(_SUM))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, F.coalesce(fold(_SUM).over(before), unit).alias(_BEFORE))
    whole = F.col(_SUM) * F.col(_BEFORE) if product else F.col(_SUM) + F.col(_BEFORE)
    return local.join(F.broadcast(offsets), _PART).withColumn(name, whole).drop(_PART, _SUM, _BEFORE)


def running_totals(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with several running sums in the order of ``keys`` at once."""
    dealt = stored(df.repartitionByRange(*keys).withColumns({_PART: F.spark_partition_id()} | values), "dealt")
    inner = Window.partitionBy(_PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({x: F.sum(x).over(inner) for x in values})
    totals = dealt.groupBy(_PART).agg(*(F.sum(x).alias(x) for x in values))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{_BEFORE}_{x}") for x in values))
    whole = local.join(F.broadcast(offsets), _PART).withColumns({x: F.col(x) + F.col(f"{_BEFORE}_{x}") for x in values})
    return whole.drop(_PART, *(f"{_BEFORE}_{x}" for x in values))


def _flat(a: Array) -> Array:
    return a if a.ndim == 1 else a.relabel({"i0": a.flat()}, (a.size,))


def _lane(a: Array, axis: int | None) -> tuple[Array, int]:
    return (_flat(a), 0) if axis is None else (a, a.axis(axis))


def cumsum(a: Array, axis: int | None = None) -> Array:
    a, axis = _lane(a, axis)
    if a.ndim == 1:
        return Array(running_total(a.df, ["i0"], F.col("v"), "v"), a.shape)
    return a.map(lambda v: F.sum(v).over(a.over(axis).rowsBetween(Window.unboundedPreceding, 0)))


def cumprod(a: Array, axis: int | None = None) -> Array:
    """Running product; a zero stays zero from there on."""
    a, axis = _lane(a, axis)
    if a.ndim == 1:
        return Array(running_total(a.df, ["i0"], F.col("v"), "v", product=True), a.shape)
    return a.map(lambda v: F.product(v).over(a.over(axis).rowsBetween(Window.unboundedPreceding, 0)))


def nancumsum(a: Array, axis: int | None = None) -> Array:
    return cumsum(a.map(lambda v: F.nanvl(v, F.lit(0.0))), axis)


def nancumprod(a: Array, axis: int | None = None) -> Array:
    return cumprod(a.map(lambda v: F.nanvl(v, F.lit(1.0))), axis)


def _with_initial(a: Array, axis: int, first: Any) -> Array:
    shifted = a.df.withColumn(axis_name(axis), F.col(axis_name(axis)) + 1)
    start = a.df.filter(F.col(axis_name(axis)) == 0).withColumn("v", F.lit(first).cast(a.dtype))
    return Array(shifted.unionByName(start), tuple(n + (k == axis) for k, n in enumerate(a.shape)))


def cumulative_sum(a: Array, axis: int = 0, include_initial: bool = False) -> Array:
    out = cumsum(a, axis)
    return _with_initial(out, a.axis(axis), 0) if include_initial else out


def cumulative_prod(a: Array, axis: int = 0, include_initial: bool = False) -> Array:
    out = cumprod(a, axis)
    return _with_initial(out, a.axis(axis), 1) if include_initial else out


def diff(a: Array, n: int = 1, axis: int = -1) -> Array:
    """n-th difference: a self-join on the index shifted by one, so that a long lane is not one task."""
    axis = a.axis(axis)
    name = axis_name(axis)
    for _ in range(n):
        nxt = a.df.select(*(F.col(x) - 1 if x == name else F.col(x) for x in a.axes), F.col("v").alias("w")).toDF(*a.axes, "w")
        out = a.df.join(nxt, a.axes).select(*a.axes, (F.col("w") - F.col("v")).alias("v"))
        a = Array(out, tuple(max(0, m - (k == axis)) for k, m in enumerate(a.shape)))
    return a


def ediff1d(a: Array, to_end: Sequence[float] = (), to_begin: Sequence[float] = ()) -> Array:
    flat = diff(_flat(a))
    spark, n, m = a.df.sparkSession, len(to_begin), flat.shape[0]
    parts = [flat.df.withColumn("i0", F.col("i0") + n)]
    extra = [(k, float(v)) for k, v in enumerate(to_begin)] + [(n + m + k, float(v)) for k, v in enumerate(to_end)]
    if extra:
        parts = [parts[0].withColumn("v", F.col("v").cast("double")), spark.createDataFrame(extra, "i0 bigint, v double")]
    return Array(concat_frames(parts), (n + m + len(to_end),))


def unwrap(a: Array, discont: float | None = None, axis: int = -1, period: float = 6.283185307179586) -> Array:
    """Take jumps of over half a period out of a phase."""
    axis = a.axis(axis)
    if a.ndim == 1:  # neighbours by a join, so that a long lane is not one task
        before = a.df.select((F.col("i0") + 1).alias("i0"), F.col("v").alias("__last"))
        step = F.col("v") - F.col("__last")
        df = a.df.join(before, "i0", "left")
    else:
        step = F.col("v") - F.lag("v").over(a.over(axis))
        df = a.df
    half = period / 2
    inside = F.pmod(step + half, F.lit(period)) - half
    inside = F.when((inside == -half) & (step > 0), F.lit(half)).otherwise(inside)
    fix = F.when(F.abs(step) < (half if discont is None else max(discont, half)), F.lit(0.0)).otherwise(inside - step)
    df = df.withColumn("__fix", F.coalesce(fix, F.lit(0.0)))
    if a.ndim == 1:
        total = running_total(df.select("i0", "v", "__fix"), ["i0"], F.col("__fix"), "__fixed")
        return Array(total.select("i0", (F.col("v") + F.col("__fixed")).alias("v")), a.shape)
    return Array(df.withColumn("v", F.col("v") + F.sum("__fix").over(a.over(axis).rowsBetween(Window.unboundedPreceding, 0))).drop("__fix"), a.shape)
