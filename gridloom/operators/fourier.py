"""Fourier transforms.

Lanes of at most ``LONG`` elements are transformed whole, a lane at a time through
Arrow, spread over tasks. A longer lane of n = n1 * n2 elements takes four steps: the
index is split in two, short transforms run over one half of it in bounded blocks of
lanes, their values are turned by the twiddle factors, and short transforms run over
the other half behind one shuffle. Lengths without a fitting divisor (primes) go as a
chirp: a convolution of twice the length, rounded up to a power of two.

Values are complex structs; real inputs may be plain numbers. Elements that an array
lacks count as zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array, axis_name
from ..storage import dealt
from .shape import roll

_COMPLEX = "struct<re:double,im:double>"
#: Lanes up to this are transformed whole; values of a block of short transforms, about.
LONG, BLOCK = 4096, 1 << 16


def _along(a: Array, axis: int, f: Callable[[np.ndarray], np.ndarray], n: int, real_out: bool = False) -> Array:
    """``f`` of each lane along an axis; lanes come out with ``n`` elements."""
    axis = a.axis(axis)
    name, others = axis_name(axis), [x for x in a.axes if x != axis_name(axis)]
    lanes, length = others or ["__lane"], a.shape[axis]
    df = a.df if others else a.df.withColumn("__lane", F.lit(0).cast("bigint"))
    is_complex = "struct" in a.dtype
    df = df.select(*lanes, name, *([F.col("v.re").alias("re"), F.col("v.im").alias("im")] if is_complex else [F.col("v").cast("double").alias("re")]))
    ddl = ", ".join([*(f"{x} bigint" for x in lanes), f"{name} bigint", f"v {'double' if real_out else _COMPLEX}"])

    def run(table: pa.Table) -> pa.Table:
        dense = np.zeros(length, complex if is_complex else float)
        at = table.column(name).to_numpy()
        dense[at] = table.column("re").to_numpy()
        if is_complex:
            dense[at] += 1j * table.column("im").to_numpy()
        out = f(dense)
        v = pa.array(out.real.astype(float)) if real_out else pa.StructArray.from_arrays([pa.array(out.real.astype(float)), pa.array(out.imag.astype(float))], ["re", "im"])
        return pa.Table.from_arrays([*(pa.repeat(table.column(x)[0], len(out)) for x in lanes), pa.array(np.arange(len(out))), v], [*lanes, name, "v"])

    out = df.groupBy(*lanes).applyInArrow(run, ddl)
    return Array(out.select(*a.axes, "v"), tuple(n if k == axis else m for k, m in enumerate(a.shape)))


def _divisor(n: int) -> int:
    """The largest divisor up to the root of n whose partner makes lanes that fit a task; 1 if there is none."""
    most = max(BLOCK, 4 * math.isqrt(n))
    return next((d for d in range(math.isqrt(n), 1, -1) if n % d == 0 and n // d <= most), 1)


def _short(df: DataFrame, others: list[str], lane: str, at: str, lanes: int, length: int, names: tuple[str, str], n: int, sign: int, turn: bool) -> DataFrame:
    """Transforms of ``length`` over ``at`` for each ``lane``: columns ``names`` (what ``lane`` and the frequency are called), re, im."""
    wide = max(1, BLOCK // length)
    blocks = df.withColumn("__b", F.floor(F.col(lane) / wide))
    ddl = ", ".join([*(f"{x} bigint" for x in (*others, *names)), "re double", "im double"])

    def run(table: pa.Table) -> pa.Table:
        first = table.column("__b")[0].as_py() * wide
        size = min(wide, lanes - first)
        dense = np.zeros((size, length), complex)
        rows, cols = table.column(lane).to_numpy() - first, table.column(at).to_numpy()
        dense[rows, cols] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        out = np.fft.fft(dense) if sign < 0 else np.fft.ifft(dense, norm="forward")
        if turn:  # the product of the two indexes is below n, so the angle is exact
            out *= np.exp(sign * 2j * np.pi / n * np.outer(np.arange(first, first + size), np.arange(length)))
        left, right = np.repeat(np.arange(first, first + size), length), np.tile(np.arange(length), size)
        values = [left, right, out.real.ravel(), out.imag.ravel()]
        return pa.Table.from_arrays([*(pa.repeat(table.column(x)[0], out.size) for x in others), *map(pa.array, values)], [*others, *names, "re", "im"])

    return dealt(blocks.groupBy(*others, "__b").applyInArrow(run, ddl))


def _four_steps(df: DataFrame, others: list[str], name: str, n: int, sign: int) -> DataFrame:
    """The unscaled transform of long lanes; ``df`` has the other axes, ``name``, re and im."""
    n1 = _divisor(n)
    if n1 == 1:
        return _chirp(df, others, name, n, sign)
    n2 = n // n1
    split = df.select(*others, F.pmod(name, F.lit(n1)).alias("__j1"), F.floor(F.col(name) / n1).alias("__j2"), "re", "im")
    turned = _short(split, others, "__j1", "__j2", n1, n2, ("__j1", "__k2"), n, sign, True)
    done = _short(turned, others, "__k2", "__j1", n2, n1, ("__k2", "__k1"), n, sign, False)
    return done.select(*others, (F.col("__k2") + F.lit(n2) * F.col("__k1")).alias(name), "re", "im")


def _times(a: tuple, b: tuple) -> tuple:
    """The product of complex numbers as pairs of columns."""
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _chirp(df: DataFrame, others: list[str], name: str, n: int, sign: int) -> DataFrame:
    """A transform of any length by a convolution with a chirp, of a length that is a power of two."""
    m = 1 << (2 * n - 1).bit_length()
    angle = lambda k: F.lit(sign * math.pi / n) * F.pmod(k * k, F.lit(2 * n))  # noqa: E731  whole numbers, exact up to 2^63
    wave = lambda k, turn: (F.cos(angle(k)), turn * F.sin(angle(k)))
    pair = lambda p: (p[0].alias("re"), p[1].alias("im"))
    own, back = F.col(name), F.least(F.col("id"), F.lit(m) - F.col("id"))
    here = (F.col("re"), F.col("im"))
    left = _four_steps(df.select(*others, name, *pair(_times(here, wave(own, 1)))), others, name, m, -1)
    ring = df.sparkSession.range(m).filter(back < n).select(F.col("id").alias(name), *pair(wave(back, -1)))
    right = _four_steps(ring, [], name, m, -1).select(name, F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = left.join(right, name).select(*others, name, *pair(_times(here, (F.col("re2"), F.col("im2")))))
    back = _four_steps(both, others, name, m, 1).filter(own < n)
    return back.select(*others, name, *pair(tuple(x / m for x in _times(here, wave(own, 1)))))


def _long(a: Array, axis: int, sign: int) -> Array:
    """The transform along a long axis, scaled as usual for the inverse."""
    name, n = axis_name(axis), a.shape[axis]
    others = [x for x in a.axes if x != name]
    is_complex = "struct" in a.dtype
    parts = [F.col("v.re").alias("re"), F.col("v.im").alias("im")] if is_complex else [F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")]
    out = _four_steps(a.df.select(*others, name, *parts), others, name, n, sign)
    scale = 1.0 if sign < 0 else float(n)
    return Array(out.select(*a.axes, F.struct((F.col("re") / scale).alias("re"), (F.col("im") / scale).alias("im")).alias("v")), a.shape)


def _resized(a: Array, axis: int, n: int) -> Array:
    return Array(a.df.filter(F.col(axis_name(axis)) < n), tuple(n if k == axis else m for k, m in enumerate(a.shape)))


def _conjugate(a: Array, scale: float = 1.0) -> Array:
    return a.map(lambda v: F.struct((v["re"] * scale).alias("re"), (v["im"] * -scale).alias("im"))) if "struct" in a.dtype else a.map(lambda v: v * scale)


def fft(a: Array, axis: int = -1) -> Array:
    axis = a.axis(axis)
    return _long(a, axis, -1) if a.shape[axis] > LONG else _along(a, axis, np.fft.fft, a.shape[axis])


def ifft(a: Array, axis: int = -1) -> Array:
    axis = a.axis(axis)
    return _long(a, axis, 1) if a.shape[axis] > LONG else _along(a, axis, np.fft.ifft, a.shape[axis])


def rfft(a: Array, axis: int = -1) -> Array:
    axis = a.axis(axis)
    half = a.shape[axis] // 2 + 1
    return _resized(_long(a, axis, -1), axis, half) if a.shape[axis] > LONG else _along(a, axis, np.fft.rfft, half)


def irfft(a: Array, axis: int = -1, n: int | None = None) -> Array:
    axis = a.axis(axis)
    n = 2 * (a.shape[axis] - 1) if n is None else n
    if n <= LONG:
        return _along(a, axis, lambda x: np.fft.irfft(x, n), n, real_out=True)
    k = F.col(axis_name(axis))
    kept = _resized(a, axis, n // 2 + 1)
    if "struct" not in a.dtype:
        kept = kept.map(lambda v: F.struct(v.cast("double").alias("re"), F.lit(0.0).alias("im")))
    # the ends are real; the other half mirrors this one
    half = kept.map(lambda v: F.struct(v["re"].alias("re"), F.when((k == 0) | (2 * k == n), 0.0).otherwise(v["im"]).alias("im")))
    mirror = _conjugate(half).df.filter((k > 0) & (2 * k < n)).withColumn(axis_name(axis), F.lit(n) - k)
    whole = Array(half.df.unionByName(mirror), tuple(n if j == axis else m for j, m in enumerate(a.shape)))
    return _long(whole, axis, 1).map(lambda v: v["re"])


def hfft(a: Array, axis: int = -1, n: int | None = None) -> Array:
    axis = a.axis(axis)
    n = 2 * (a.shape[axis] - 1) if n is None else n
    if n > LONG:
        return irfft(_conjugate(a), axis, n).map(lambda v: v * n)
    return _along(a, axis, lambda x: np.fft.hfft(x, n), n, real_out=True)


def ihfft(a: Array, axis: int = -1) -> Array:
    axis = a.axis(axis)
    n = a.shape[axis]
    return _conjugate(rfft(a, axis), 1.0 / n) if n > LONG else _along(a, axis, np.fft.ihfft, n // 2 + 1)


def _axes(a: Array, axes: Sequence[int] | None) -> list[int]:
    return list(range(a.ndim)) if axes is None else [a.axis(k) for k in axes]


def fftn(a: Array, axes: Sequence[int] | None = None) -> Array:
    for k in _axes(a, axes):
        a = fft(a, k)
    return a


def ifftn(a: Array, axes: Sequence[int] | None = None) -> Array:
    for k in _axes(a, axes):
        a = ifft(a, k)
    return a


def rfftn(a: Array, axes: Sequence[int] | None = None) -> Array:
    *rest, last = _axes(a, axes)
    return fftn(rfft(a, last), rest) if rest else rfft(a, last)


def irfftn(a: Array, s: Sequence[int] | None = None, axes: Sequence[int] | None = None) -> Array:
    *rest, last = _axes(a, axes)
    return irfft(ifftn(a, rest) if rest else a, last, None if s is None else s[-1])


fft2, ifft2, rfft2, irfft2 = fftn, ifftn, rfftn, irfftn


def fftshift(a: Array) -> Array:
    for k, n in enumerate(a.shape):
        a = roll(a, n // 2, k)
    return a


def ifftshift(a: Array) -> Array:
    for k, n in enumerate(a.shape):
        a = roll(a, (n + 1) // 2, k)
    return a


def fftfreq(spark: SparkSession, n: int, d: float = 1.0) -> Array:
    k = F.when(F.col("id") < (n + 1) // 2, F.col("id")).otherwise(F.col("id") - n)
    return Array(spark.range(n).select(F.col("id").alias("i0"), (k / (n * d)).alias("v")), (n,))


def rfftfreq(spark: SparkSession, n: int, d: float = 1.0) -> Array:
    return Array(spark.range(n // 2 + 1).select(F.col("id").alias("i0"), (F.col("id") / (n * d)).alias("v")), (n // 2 + 1,))


def fft_column(df: DataFrame, name: str) -> DataFrame:
    """The transform of an array column (cell form), a lane per row: ``<name>_re`` and ``<name>_im``."""
    kinds = {c: t for c, t in df.dtypes}
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), f"`{name}_re` array<double>", f"`{name}_im` array<double>"])

    def run(batches):
        for batch in batches:
            lanes = [np.fft.fft(np.asarray(x, float)) if x else np.zeros(0) for x in batch.column(name).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x.real.tolist() for x in lanes], pa.list_(pa.float64())), pa.array([x.imag.tolist() for x in lanes], pa.list_(pa.float64()))],
                [*batch.schema.names, f"{name}_re", f"{name}_im"],
            )

    return df.mapInArrow(run, ddl)
