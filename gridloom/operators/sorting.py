"""Sorting, ordered search, sets, bins and counts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..arrays import Array, axis_name, number_rows
from ..functions.core import real
from .selection import partitioned


def sort(a: Array, axis: int = -1) -> Array:
    """Ascending along an axis; NaN last. A 1-D array is numbered in parallel, not in one task."""
    if a.ndim == 1:
        return Array(number_rows(a.df.select("v", F.col("i0").alias("__was")), ["v", "__was"], "i0").select("i0", "v"), a.shape)
    return _ranked(a, axis, "v")


def argsort(a: Array, axis: int = -1) -> Array:
    """Indices that sort, stable."""
    if a.ndim == 1:
        out = number_rows(a.df.select("v", F.col("i0").alias("__was")), ["v", "__was"], "i0")
        return Array(out.select("i0", F.col("__was").alias("v")), a.shape)
    return _ranked(a, axis, axis_name(a.axis(axis)))


def _ranked(a: Array, axis: int, take: str) -> Array:
    name = axis_name(a.axis(axis))
    w = Window.partitionBy(*(x for x in a.axes if x != name)).orderBy("v", name)
    out = a.df.withColumn("__rank", (F.row_number().over(w) - 1).cast("bigint")).withColumn("v", F.col(take))
    return Array(out.select(*(F.col("__rank" if x == name else x).alias(x) for x in a.axes), "v"), a.shape)


def partition(a: Array, kth: int, axis: int = -1) -> Array:
    """The kth value in its sorted place, smaller ones before it: by selection for a 1-D array, in a lane's window else."""
    if a.ndim == 1:
        return Array(partitioned(a, kth).select("i0", "v"), a.shape)
    return sort(a, axis)


def argpartition(a: Array, kth: int, axis: int = -1) -> Array:
    if a.ndim == 1:
        return Array(partitioned(a, kth).select("i0", F.col("was").alias("v")), a.shape)
    return argsort(a, axis)


def lexsort(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Positions i0 and the ``index`` that sorts by several keys, the last one first."""
    return number_rows(df.select(index, *keys), [*reversed(keys), index], "i0").select("i0", F.col(index).alias("v"))


def top_k(df: DataFrame, value: str, k: int) -> DataFrame:
    return df.orderBy(F.col(value).desc()).limit(k)


def searchsorted(edges: Sequence[float], v: Any, side: str = "left") -> Column:
    """Insertion points into a short sorted list of edges."""
    at = F.array(*(F.lit(float(e)) for e in edges))
    test = (lambda e: e < real(v)) if side == "left" else (lambda e: e <= real(v))
    return F.size(F.filter(at, test))


def searchsorted_frame(a: DataFrame, key: str, queries: DataFrame, value: str, side: str = "left") -> DataFrame:
    """Insertion points of ``queries`` into a long column: both are ranked together, no range join.

    Adds ``insertion`` to the distinct values of ``queries``.
    """
    from .windows import running_total

    first = 0 if side == "left" else 1  # a query stands before or after equal keys
    both = a.select(F.col(key).cast("double").alias("x"), F.lit(1 - first).alias("o"), F.lit(1).alias("w")).unionAll(
        queries.select(F.col(value).cast("double").alias("x"), F.lit(first).alias("o"), F.lit(0).alias("w")).distinct()
    )
    ranked = running_total(both, ["x", "o"], F.col("w"), "insertion")
    return ranked.filter("w = 0").select(F.col("x").alias(value), F.col("insertion").cast("bigint").alias("insertion"))


def digitize(x: Any, bins: Sequence[float], right: bool = False) -> Column:
    """Bin numbers for rising or falling bins."""
    if len(bins) > 1 and bins[0] > bins[-1]:
        rising = list(reversed(bins))
        return F.lit(len(bins)) - searchsorted(rising, x, "right" if right else "left")
    return searchsorted(bins, x, "left" if right else "right")


def _range(df: DataFrame, names: Sequence[str], ranges: Sequence[tuple[float, float] | None]) -> list[tuple[float, float]]:
    asked = [n for n, r in zip(names, ranges) if r is None]
    found = df.agg(*(f(real(n)).alias(f"{f.__name__}_{n}") for n in asked for f in (F.min, F.max))).first() if asked else {}
    out = []
    for n, r in zip(names, ranges):
        low, high = r if r is not None else (found[f"min_{n}"], found[f"max_{n}"])
        low, high = (0.0, 1.0) if low is None else (float(low), float(high))
        out.append((low - 0.5, high + 0.5) if low == high else (low, high))
    return out


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    """The number of the bin, the last one closed; null outside."""
    k = F.floor((x - low) * bins / (high - low))
    return F.when((x >= low) & (x <= high), F.least(k, F.lit(bins - 1)))


def histogramdd(df: DataFrame, names: Sequence[str], bins: int | Sequence[int] = 10, ranges: Sequence[tuple[float, float] | None] | None = None, density: bool = False) -> DataFrame:
    """Counts on a grid of equal bins: b0, b1, ..., count (and density); empty bins included."""
    sizes = [bins] * len(names) if isinstance(bins, int) else list(bins)
    limits = _range(df, names, ranges or [None] * len(names))
    cells = [_bin(real(n), lo, hi, b).alias(f"b{k}") for k, (n, (lo, hi), b) in enumerate(zip(names, limits, sizes))]
    keys = [f"b{k}" for k in range(len(names))]
    counted = df.select(*cells).dropna().groupBy(*keys).agg(F.count("*").alias("count"))
    from ..arrays import grid

    every = grid(df.sparkSession, sizes).df.drop("v").toDF(*keys)
    out = every.join(counted, keys, "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    if density:
        area = 1.0
        for (lo, hi), b in zip(limits, sizes):
            area *= (hi - lo) / b
        total = out.agg(F.sum("count")).first()[0]
        out = out.withColumn("density", F.col("count") / F.lit(max(1, total) * area))
    return out


def histogram(df: DataFrame, name: str, bins: int = 10, range: tuple[float, float] | None = None) -> DataFrame:  # noqa: A002
    """b0, count, low and high of equal bins."""
    ((low, high),) = _range(df, [name], [range])
    step = (high - low) / bins
    return histogramdd(df, [name], bins, [(low, high)]).withColumns({"low": F.col("b0") * step + low, "high": (F.col("b0") + 1) * step + low})


def histogram_bin_edges(df: DataFrame, name: str, bins: int = 10, range: tuple[float, float] | None = None) -> DataFrame:  # noqa: A002
    ((low, high),) = _range(df, [name], [range])
    return df.sparkSession.range(bins + 1).select(F.col("id").alias("i0"), (F.col("id") * ((high - low) / bins) + low).alias("v"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int | Sequence[int] = 10, ranges: Any = None, density: bool = False) -> DataFrame:
    return histogramdd(df, [x, y], bins, ranges, density)


def bincount(df: DataFrame, name: str, minlength: int = 0) -> DataFrame:
    """i0 and v: how often each integer from 0 occurs."""
    counted = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("bigint").alias("i0")).agg(F.count("*").alias("v"))
    most = counted.agg(F.max("i0")).first()[0]
    every = df.sparkSession.range(max(minlength, 0 if most is None else most + 1)).select(F.col("id").alias("i0"))
    return every.join(counted, "i0", "left").select("i0", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))


# sets of one column named v


def _values(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).alias("v"))


def unique(df: DataFrame, name: str) -> DataFrame:
    return _values(df, name).distinct()


unique_values = unique


def unique_counts(df: DataFrame, name: str) -> DataFrame:
    return _values(df, name).groupBy("v").agg(F.count("*").alias("count"))


def unique_all(df: DataFrame, name: str, index: str) -> DataFrame:
    """v, its first index, its count and its rank among the distinct values."""
    found = df.groupBy(F.col(name).alias("v")).agg(F.min(index).alias("first_index"), F.count("*").alias("count"))
    return number_rows(found, ["v"], "inverse")


def unique_inverse(df: DataFrame, name: str, index: str) -> DataFrame:
    """index and the rank of its value; ranks are made on distinct values and joined back."""
    ranks = number_rows(unique(df, name), ["v"], "inverse")
    return df.select(index, F.col(name).alias("v")).join(ranks, "v").select(index, "v", "inverse")


def union1d(a: DataFrame, b: DataFrame, name: str, other: str | None = None) -> DataFrame:
    return _values(a, name).union(_values(b, other or name)).distinct()


def intersect1d(a: DataFrame, b: DataFrame, name: str, other: str | None = None) -> DataFrame:
    return _values(a, name).intersect(_values(b, other or name))


def setdiff1d(a: DataFrame, b: DataFrame, name: str, other: str | None = None) -> DataFrame:
    return _values(a, name).subtract(_values(b, other or name))


def setxor1d(a: DataFrame, b: DataFrame, name: str, other: str | None = None) -> DataFrame:
    """Values of exactly one side, in one shuffle."""
    tagged = _values(a, name).withColumn("s", F.lit(1)).union(_values(b, other or name).withColumn("s", F.lit(2)))
    return tagged.groupBy("v").agg(F.bit_or("s").alias("s")).filter("s <> 3").select("v")


def isin(df: DataFrame, name: str, tests: DataFrame, test: str, invert: bool = False) -> DataFrame:
    """``df`` with the column ``found``; equality of values, so -0.0 is 0.0."""
    keys = tests.select(F.col(test).alias("__t")).distinct().withColumn("__f", F.lit(True))
    out = df.join(keys, F.col(name) == F.col("__t"), "left")
    return out.withColumn("found", F.col("__f").isNull() if invert else F.col("__f").isNotNull()).drop("__t", "__f")


in1d = isin


def members(df: DataFrame, name: str, tests: DataFrame, test: str, invert: bool = False) -> DataFrame:
    """The rows whose value is (or, inverted, is not) among the tests."""
    return df.join(tests.select(F.col(test).alias("__t")), F.col(name) == F.col("__t"), "left_anti" if invert else "left_semi")
