"""Signals, interpolation, polynomials and user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..arrays import Array, axis_name
from ..functions.core import real
from .linalg import gram


#: Kernels up to this are sent to every task; the least elements of a block, and kernels up to this are summed directly.
MAX_KERNEL, BLOCK, DIRECT = 1 << 16, 1 << 14, 512


def convolve(a: Array, kernel: Sequence[float] | Array, mode: str = "full", max_kernel: int = MAX_KERNEL) -> Array:
    """Convolution of two arrays of any length.

    With a kernel (the shorter of the two) of at most ``max_kernel`` elements, the array is dealt
    in blocks, each with as many elements of the block before as the kernel reaches back: one
    shuffle. Longer kernels go through transforms of both.
    """
    n, m = a.shape[0], kernel.shape[0] if isinstance(kernel, Array) else len(kernel)
    if not n or not m:
        raise ValueError("an array to convolve is empty")
    if isinstance(kernel, Array):
        long, short = (a, kernel) if m <= n else (kernel, a)
        if short.shape[0] <= max_kernel:
            weights = np.zeros(short.shape[0])  # at most max_kernel rows come to the driver
            for r in short.df.select("i0", "v").collect():
                weights[r[0]] = r[1]
            out = _by_blocks(long, weights)
        else:
            out = _by_transforms(long, short)
    else:
        out = _by_blocks(a, np.asarray(kernel, float))
    low, size = {"full": (0, n + m - 1), "same": ((min(n, m) - 1) // 2, max(n, m)), "valid": (min(n, m) - 1, max(n, m) - min(n, m) + 1)}[mode]
    kept = out.filter((F.col("i0") >= low) & (F.col("i0") < low + size))
    return Array(kept.select((F.col("i0") - low).alias("i0"), "v"), (size,))


def _by_blocks(a: Array, weights: np.ndarray) -> DataFrame:
    """The full convolution: every block gets its elements and those that reach into it."""
    n, m = a.shape[0], len(weights)
    size = max(BLOCK, 1 << (4 * m).bit_length())
    own = F.floor(F.col("i0") / size)
    reaches = F.col("i0") % size >= size - (m - 1)
    spread = a.df.select("i0", F.col("v").cast("double").alias("v"), F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))).alias("__b"))

    def run(table: pa.Table) -> pa.Table:
        low = table.column("__b")[0].as_py() * size
        dense = np.zeros(size + m - 1)
        dense[table.column("i0").to_numpy() - low + m - 1] = table.column("v").to_numpy()
        if m <= DIRECT or not np.isfinite(dense).all():
            out = np.convolve(dense, weights, "valid")
        else:
            length = 1 << (len(dense) + m).bit_length()
            out = np.fft.irfft(np.fft.rfft(dense, length) * np.fft.rfft(weights, length), length)[m - 1 : m - 1 + size]
        out = out[: max(0, n + m - 1 - low)]
        return pa.table({"i0": np.arange(low, low + len(out)), "v": out})

    return spread.groupBy("__b").applyInArrow(run, "i0 bigint, v double")


def _by_transforms(a: Array, b: Array) -> DataFrame:
    """The full convolution as the product of two transforms."""
    from .fourier import fft, ifft

    size = a.shape[0] + b.shape[0] - 1
    length = 1 << size.bit_length()
    left, right = (fft(Array(x.df.select("i0", F.col("v").cast("double").alias("v")), (length,))).df for x in (a, b))
    x, y = F.col("v"), F.col("w")
    product = F.struct((x["re"] * y["re"] - x["im"] * y["im"]).alias("re"), (x["re"] * y["im"] + x["im"] * y["re"]).alias("im"))
    both = left.join(right.withColumnRenamed("v", "w"), "i0").select("i0", product.alias("v"))
    return ifft(Array(both, (length,))).df.filter(F.col("i0") < size).select("i0", x["re"].alias("v"))


def correlate(a: Array, kernel: Sequence[float] | Array, mode: str = "full", max_kernel: int = MAX_KERNEL) -> Array:
    if isinstance(kernel, Array):
        m = kernel.shape[0]
        return convolve(a, kernel.relabel({"i0": F.lit(m - 1) - F.col("i0")}, (m,)), mode, max_kernel)
    return convolve(a, list(reversed(kernel)), mode)


def gradient(a: Array, spacing: float = 1.0, axis: int = -1, coordinates: str | None = None) -> Array:
    """Central differences, one-sided at the ends; neighbours come by equi-joins on the index."""
    axis = a.axis(axis)
    name, n = axis_name(axis), a.shape[axis]
    at = F.col(coordinates) if coordinates else F.col(name) * spacing
    base = a.df.select(*a.axes, F.col("v").cast("double").alias("v"), at.cast("double").alias("__x"))

    def near(step: int, p: str) -> DataFrame:
        return base.select(*((F.col(x) - step).alias(x) if x == name else F.col(x) for x in a.axes), F.col("v").alias(f"{p}v"), F.col("__x").alias(f"{p}x"))

    both = base.join(near(1, "n"), a.axes, "left").join(near(-1, "p"), a.axes, "left")
    low, lowx = F.coalesce("pv", "v"), F.coalesce("px", "__x")
    high, highx = F.coalesce("nv", "v"), F.coalesce("nx", "__x")
    if n < 2:
        raise ValueError("a gradient needs two points")
    return Array(both.select(*a.axes, ((high - low) / (highx - lowx)).alias("v")), a.shape)


def trapezoid(a: Array, dx: float = 1.0, axis: int = -1) -> Array:
    """The trapezoid rule: half weights at the ends, so one grouped sum does."""
    axis = a.axis(axis)
    name = axis_name(axis)
    weight = F.when(F.col(name).isin(0, a.shape[axis] - 1), 0.5).otherwise(1.0)
    left = [k for k in range(a.ndim) if k != axis]
    out = a.df.groupBy(*(axis_name(k) for k in left)).agg((F.sum(F.col("v") * weight) * dx).alias("v"))
    return Array(out.select(*(F.col(axis_name(k)).alias(axis_name(j)) for j, k in enumerate(left)), "v"), tuple(a.shape[k] for k in left))


def trapezoid_columns(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """The rule over uneven points: the area under y(x) of each lane."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (real(y) + F.lead(real(y)).over(w)) * (F.lead(real(x)).over(w) - real(x)) / 2
    return df.withColumn("__part", part).groupBy(*keys).agg(F.coalesce(F.sum("__part"), F.lit(0.0)).alias("area"))


def interp(x: Any, xp: Sequence[float], fp: Sequence[float], left: float | None = None, right: float | None = None) -> Column:
    """Piecewise linear through a short list of points."""
    x = real(x)
    low, high = fp[0] if left is None else left, fp[-1] if right is None else right
    points = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(xp, fp)))
    k = F.size(F.filter(points, lambda p: p["x"] <= x))
    a, b = F.get(points, k - 1), F.get(points, k)
    inside = a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
    return F.when(x < xp[0], F.lit(float(low))).when(x > xp[-1], F.lit(float(high))).when(x == xp[-1], F.lit(float(fp[-1]))).otherwise(inside)


# polynomials, the highest power first


def polyval(p: Sequence[float], x: Any) -> Column:
    """Horner's scheme in one expression."""
    return reduce(lambda acc, c: acc * real(x) + F.lit(float(c)), p[1:], F.lit(float(p[0])) if p else F.lit(0.0))


def polyder(p: Sequence[float], m: int = 1) -> list[float]:
    p = list(map(float, p))
    for _ in range(m):
        n = len(p) - 1
        p = [c * (n - k) for k, c in enumerate(p[:-1])]
    return p or [0.0]


def polyint(p: Sequence[float], m: int = 1, k: Sequence[float] | float = 0.0) -> list[float]:
    p, constants = list(map(float, p)), list(k) if isinstance(k, Sequence) else [k] * m
    for c in constants[:m]:
        n = len(p)
        p = [*(v / (n - j) for j, v in enumerate(p)), float(c)]
    return p


def polyfit(df: DataFrame, x: str, y: str, deg: int, w: str | None = None) -> np.ndarray:
    """Least squares from the sums of powers: one aggregation, then a small solve. Weights multiply squared errors.

    x is centred and scaled by its own moments first, which keeps the sums well conditioned.
    """
    mean, scale = df.agg(F.avg(real(x)), F.stddev_pop(real(x))).first()
    scale = scale or 1.0
    z = (real(x) - mean) / scale
    root = F.sqrt(real(w)) if w else F.lit(1.0)
    powers = [(F.pow(z, F.lit(float(deg - k))) * root).alias(f"p{k}") for k in range(deg + 1)]
    names = [f"p{k}" for k in range(deg + 1)] + ["t"]
    g = gram(df.select(*powers, (real(y) * root).alias("t")), names)
    inner = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    out = np.zeros(1)
    for c in inner:  # back from z to x
        out = np.polyadd(np.polymul(out, [1 / scale, -mean / scale]), [c])
    return out[-(deg + 1) :]


def roots(p: Sequence[float]) -> np.ndarray:
    return np.roots(p)


# user functions


def apply_along_axis(f: Callable[[np.ndarray], Any], axis: int, a: Array) -> Array:
    """A Python function of each lane that gives a number or as many numbers as it likes (all lanes alike)."""
    axis = a.axis(axis)
    name, others = axis_name(axis), [x for x in a.axes if x != axis_name(axis)]
    length, probe = a.shape[axis], np.asarray(f(np.ones(a.shape[axis])))
    lanes = others or ["__lane"]
    df = a.df if others else a.df.withColumn("__lane", F.lit(0).cast("bigint"))
    ddl = ", ".join([*(f"{x} bigint" for x in lanes), f"{name} bigint", "v double"])

    def run(table: pa.Table) -> pa.Table:
        dense = np.zeros(length)
        dense[table.column(name).to_numpy()] = table.column("v").to_numpy()
        out = np.atleast_1d(np.asarray(f(dense), float))
        return pa.Table.from_arrays([*(pa.repeat(table.column(x)[0], len(out)) for x in lanes), pa.array(np.arange(len(out))), pa.array(out)], [*lanes, name, "v"])

    out = df.select(*lanes, name, F.col("v").cast("double").alias("v")).groupBy(*lanes).applyInArrow(run, ddl)
    if probe.ndim:
        return Array(out.select(*a.axes, "v"), tuple(len(probe) if k == axis else n for k, n in enumerate(a.shape)))
    return Array(out.select(*(F.col(x).alias(axis_name(k)) for k, x in enumerate(others)), "v"), tuple(n for k, n in enumerate(a.shape) if k != axis))


def vectorize(f: Callable[..., Any], otype: str = "double") -> Callable[..., Column]:
    """A scalar Python function as an Arrow-batched Column function."""

    def run(*series):
        return pd.Series([f(*xs) for xs in zip(*series)])

    def apply(*columns: Any) -> Column:
        return F.pandas_udf(run, otype, F.PandasUDFType.SCALAR)(*columns)

    return apply


def frompyfunc(f: Callable[..., Any], nin: int, nout: int, otype: str = "double") -> Callable[..., Column]:
    """As :func:`vectorize`; several outputs come as an array."""
    if nout == 1:
        return vectorize(f, otype)
    return vectorize(lambda *xs: list(f(*xs)), f"array<{otype}>")
