"""Aggregations: Column aggregates, and reductions of arrays along axes.

The Column forms go into ``groupBy().agg()``, where "reduce along an axis" is grouping
by the other axes; partial sums come from Spark. ``var`` and ``std`` are population
moments. ``max`` and ``min`` skip NaN; an empty or all-NaN input gives -inf or inf.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..arrays import Array, axis_name
from ..functions.core import INF, NAN, col, drop_nan, real
from ..functions.predicates import truthy


def sum(x: Any) -> Column:  # noqa: A001
    return F.coalesce(F.sum(col(x)), F.lit(0))


def prod(x: Any) -> Column:
    return F.coalesce(F.product(col(x)), F.lit(1.0))


def mean(x: Any) -> Column:
    return F.coalesce(F.avg(col(x)), F.lit(NAN))


def var(x: Any) -> Column:
    return F.coalesce(F.var_pop(col(x)), F.lit(NAN))


def std(x: Any) -> Column:
    return F.coalesce(F.stddev_pop(col(x)), F.lit(NAN))


def max(x: Any) -> Column:  # noqa: A001
    return F.coalesce(F.max(drop_nan(x)), F.lit(-INF))


def min(x: Any) -> Column:  # noqa: A001
    return F.coalesce(F.min(drop_nan(x)), F.lit(INF))


amax, amin = max, min


def ptp(x: Any) -> Column:
    return max(x) - min(x)


def argmax(x: Any, index: Any) -> Column:
    """The first index of the largest value."""
    return F.max_by(col(index), F.struct(col(x), -col(index)))


def argmin(x: Any, index: Any) -> Column:
    return F.min_by(col(index), F.struct(col(x), col(index)))


def _valid(out: Column) -> Column:
    return F.when(out.isNull(), F.raise_error(F.lit("all values are NaN")).cast("bigint")).otherwise(out)


def nanargmax(x: Any, index: Any) -> Column:
    v = drop_nan(x)
    return _valid(F.max_by(col(index), F.when(v.isNotNull(), F.struct(v, -col(index)))))


def nanargmin(x: Any, index: Any) -> Column:
    v = drop_nan(x)
    return _valid(F.min_by(col(index), F.when(v.isNotNull(), F.struct(v, col(index)))))


def nansum(x: Any) -> Column:
    return F.coalesce(F.sum(drop_nan(x)), F.lit(0.0))


def nanprod(x: Any) -> Column:
    return F.coalesce(F.product(drop_nan(x)), F.lit(1.0))


def _or_nan(out: Column) -> Column:
    return F.coalesce(out, F.lit(NAN))


def nanmean(x: Any) -> Column:
    return _or_nan(F.avg(drop_nan(x)))


def nanvar(x: Any) -> Column:
    return _or_nan(F.var_pop(drop_nan(x)))


def nanstd(x: Any) -> Column:
    return _or_nan(F.stddev_pop(drop_nan(x)))


def nanmax(x: Any) -> Column:
    return _or_nan(F.max(drop_nan(x)))


def nanmin(x: Any) -> Column:
    return _or_nan(F.min(drop_nan(x)))


def nanmedian(x: Any) -> Column:
    return _or_nan(F.median(drop_nan(x)))


def nanpercentile(x: Any, q: Any) -> Column:
    return F.percentile(drop_nan(x), _share(q, 100))


def nanquantile(x: Any, q: Any) -> Column:
    return F.percentile(drop_nan(x), _share(q, 1))


def _share(q: Any, whole: float) -> Any:
    return F.array(*(F.lit(p / whole) for p in q)) if isinstance(q, Sequence) else q / whole


def median(x: Any) -> Column:
    return F.median(real(x))


def percentile(x: Any, q: Any) -> Column:
    """Exact, with linear interpolation; a list of q gives an array."""
    return F.percentile(real(x), _share(q, 100))


def quantile(x: Any, q: Any) -> Column:
    return F.percentile(real(x), _share(q, 1))


def all(x: Any) -> Column:  # noqa: A001
    return F.coalesce(F.bool_and(truthy(x)), F.lit(True))


def any(x: Any) -> Column:  # noqa: A001
    return F.coalesce(F.bool_or(truthy(x)), F.lit(False))


def count_nonzero(x: Any) -> Column:
    return F.count_if(truthy(x))


def average(x: Any, weights: Any = None) -> Column:
    """Weighted mean; NaN where the weights add up to 0."""
    if weights is None:
        return mean(x)
    total = F.sum(real(weights))
    return F.coalesce(F.sum(real(x) * real(weights)) / F.when(total != 0, total), F.lit(NAN))


def cov(df: DataFrame, names: Sequence[str], ddof: int = 1) -> DataFrame:
    """The covariance matrix of columns: rows i0, i1, v, from one aggregation."""
    f = F.covar_samp if ddof == 1 else F.covar_pop
    return _matrix(df, names, lambda a, b: f(real(a), real(b)))


def corrcoef(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The Pearson matrix of columns; NaN where a column is constant, 1 on the diagonal."""
    return _matrix(df, names, lambda a, b: F.lit(1.0) if a == b else F.coalesce(F.corr(real(a), real(b)), F.lit(NAN)))


def _matrix(df: DataFrame, names: Sequence[str], f) -> DataFrame:
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = df.agg(*(f(names[i], names[j]).alias(f"m{i}_{j}") for i, j in pairs), F.count("*").alias("n"))
    cells = [F.struct(F.lit(i).alias("i0"), F.lit(j).alias("i1"), F.col(f"m{min_(i, j)}_{max_(i, j)}").alias("v")) for i in range(len(names)) for j in range(len(names))]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def min_(a: int, b: int) -> int:
    return a if a < b else b


def max_(a: int, b: int) -> int:
    return a if a > b else b


def reduce_axes(a: Array, aggregate, axis: int | Sequence[int] | None = None) -> Array:
    """Reduce an array with a Column aggregate of ``v``, over one, several or all axes."""
    axes = range(a.ndim) if axis is None else [axis] if isinstance(axis, int) else axis
    gone = {a.axis(k) for k in axes}
    left = [k for k in range(a.ndim) if k not in gone]
    out = a.df.groupBy(*(axis_name(k) for k in left)).agg(aggregate("v").alias("v"))
    return Array(out.select(*(F.col(axis_name(k)).alias(axis_name(n)) for n, k in enumerate(left)), "v"), tuple(a.shape[k] for k in left))


def skew(x: Any) -> Column:
    """m3 / m2 ** 1.5 of population moments; 0 for equal values."""
    return F.when(F.var_pop(col(x)) == 0, 0.0).otherwise(F.skewness(col(x)))


def kurtosis(x: Any) -> Column:
    """m4 / m2 ** 2 - 3 of population moments; 0 for equal values."""
    return F.when(F.var_pop(col(x)) == 0, 0.0).otherwise(F.kurtosis(col(x)))


def moment(a: Array, k: int, axis: int | Sequence[int] | None = None) -> Array:
    """The k-th central moment: the means, a row for each group, are joined back."""
    axes = range(a.ndim) if axis is None else [axis] if isinstance(axis, int) else axis
    gone = {a.axis(x) for x in axes}
    left = [axis_name(x) for x in range(a.ndim) if x not in gone]
    means = a.df.groupBy(*left).agg(F.avg("v").alias("__mean"))
    both = a.df.join(means, left) if left else a.df.crossJoin(F.broadcast(means))  # a single mean
    return reduce_axes(Array(both.withColumn("v", F.pow(F.col("v") - F.col("__mean"), F.lit(float(k)))), a.shape), mean, axis)


def arg_reduce(a: Array, aggregate, axis: int) -> Array:
    """argmax and its relatives along an axis."""
    name = axis_name(a.axis(axis))
    return reduce_axes(a, lambda v: aggregate(v, name), axis)


def apply_over_axes(f, a: Array, axes: Sequence[int]) -> Array:
    """Fold a reduction over axes one by one, keeping them with length 1."""
    for axis in axes:
        k = a.axis(axis)
        others = [axis_name(x) for x in range(a.ndim) if x != k]
        out = a.df.groupBy(*others).agg(f("v").alias("v")).withColumn(axis_name(k), F.lit(0).cast("bigint"))
        a = Array(out.select(*a.axes, "v"), tuple(1 if x == k else n for x, n in enumerate(a.shape)))
    return a
