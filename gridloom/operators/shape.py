"""Shape, order and selection: projections, unions and joins on index columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..arrays import Array, axis_name, concat_frames, grid, number_rows, unravel


def _columns(a: Array) -> dict[str, Column]:
    return {x: F.col(x) for x in a.axes}


def reshape(a: Array, shape: Sequence[int]) -> Array:
    """Row-major; one -1 stands for what is left."""
    shape = list(shape)
    if -1 in shape:
        shape[shape.index(-1)] = a.size // math.prod(n for n in shape if n != -1)
    if math.prod(shape) != a.size:
        raise ValueError(f"cannot reshape {a.shape} to {tuple(shape)}")
    return a.relabel({axis_name(k): c for k, c in enumerate(unravel(a.flat(), shape))}, shape)


def ravel(a: Array) -> Array:
    return reshape(a, [-1]) if a.size else Array(a.df.select(F.lit(0).cast("bigint").alias("i0"), "v"), (0,))


flatten = ravel


def transpose(a: Array, axes: Sequence[int] | None = None) -> Array:
    order = list(reversed(range(a.ndim))) if axes is None else [a.axis(k) for k in axes]
    return a.relabel({axis_name(k): F.col(axis_name(o)) for k, o in enumerate(order)}, [a.shape[o] for o in order])


permute_dims = transpose


def swapaxes(a: Array, axis1: int, axis2: int) -> Array:
    order = list(range(a.ndim))
    p, q = a.axis(axis1), a.axis(axis2)
    order[p], order[q] = order[q], order[p]
    return transpose(a, order)


def matrix_transpose(a: Array) -> Array:
    return swapaxes(a, -1, -2)


def moveaxis(a: Array, source: int | Sequence[int], destination: int | Sequence[int]) -> Array:
    source = [source] if isinstance(source, int) else list(source)
    destination = [destination] if isinstance(destination, int) else list(destination)
    moved = {a.axis(d): a.axis(s) for s, d in zip(source, destination)}
    rest = iter(k for k in range(a.ndim) if k not in moved.values())
    return transpose(a, [moved[k] if k in moved else next(rest) for k in range(a.ndim)])


def rollaxis(a: Array, axis: int, start: int = 0) -> Array:
    axis = a.axis(axis)
    start = start + a.ndim if start < 0 else start
    return moveaxis(a, axis, start - 1 if start > axis else start)


def expand_dims(a: Array, axis: int) -> Array:
    axis = axis % (a.ndim + 1)
    columns = [F.col(x) for x in a.axes]
    columns.insert(axis, F.lit(0))
    return a.relabel({axis_name(k): c for k, c in enumerate(columns)}, [*a.shape[:axis], 1, *a.shape[axis:]])


def squeeze(a: Array) -> Array:
    left = [k for k, n in enumerate(a.shape) if n != 1]
    return a.relabel({axis_name(n): F.col(axis_name(k)) for n, k in enumerate(left)}, [a.shape[k] for k in left])


def atleast_1d(a: Array) -> Array:
    return a if a.ndim else expand_dims(a, 0)


def atleast_2d(a: Array) -> Array:
    return a if a.ndim >= 2 else expand_dims(atleast_1d(a), 0)


def atleast_3d(a: Array) -> Array:
    return a if a.ndim >= 3 else expand_dims(atleast_2d(a), 2)


def flip(a: Array, axis: int | Sequence[int] | None = None) -> Array:
    axes = range(a.ndim) if axis is None else [axis] if isinstance(axis, int) else axis
    columns = _columns(a)
    for k in axes:
        name = axis_name(a.axis(k))
        columns[name] = a.shape[a.axis(k)] - 1 - F.col(name)
    return a.relabel(columns, a.shape)


def flipud(a: Array) -> Array:
    return flip(a, 0)


def fliplr(a: Array) -> Array:
    return flip(a, 1)


def roll(a: Array, shift: int, axis: int | None = None) -> Array:
    if axis is None:
        flat = ravel(a)
        moved = flat.relabel({"i0": F.pmod(F.col("i0") + shift, F.lit(max(1, a.size)))}, flat.shape)
        return reshape(moved, a.shape)
    name, n = axis_name(a.axis(axis)), a.shape[a.axis(axis)]
    return a.relabel(_columns(a) | {name: F.pmod(F.col(name) + shift, F.lit(max(1, n)))}, a.shape)


def rot90(a: Array, k: int = 1, axes: tuple[int, int] = (0, 1)) -> Array:
    p, q = axes
    for _ in range(k % 4):
        a = swapaxes(flip(a, q), p, q)
    return a


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    ndim = max((len(s) for s in shapes), default=0)
    out = []
    for k in range(ndim):
        sizes = {s[len(s) - ndim + k] for s in shapes if len(s) - ndim + k >= 0} - {1}
        if len(sizes) > 1:
            raise ValueError(f"shapes do not broadcast: {shapes}")
        out.append(sizes.pop() if sizes else 1)
    return tuple(out)


def broadcast_to(a: Array, shape: Sequence[int]) -> Array:
    """Stretched axes become a sequence per element, not a join."""
    shape = tuple(shape)
    if broadcast_shapes(a.shape, shape) != shape:
        raise ValueError(f"cannot broadcast {a.shape} to {shape}")
    lead = len(shape) - a.ndim
    df = a.df.select(*(F.col(x).alias(axis_name(k + lead)) for k, x in enumerate(a.axes)), "v")
    for k, n in enumerate(shape):
        if k < lead or a.shape[k - lead] == 1 != n:
            df = df.withColumn(axis_name(k), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))) if n else F.explode(F.array().cast("array<bigint>")))
    return Array(df.select(*(axis_name(k) for k in range(len(shape))), "v"), shape)


def broadcast_arrays(*arrays: Array) -> list[Array]:
    shape = broadcast_shapes(*(a.shape for a in arrays))
    return [broadcast_to(a, shape) for a in arrays]


def elementwise(f: Callable[..., Column], *arrays: Array) -> Array:
    """f of several arrays: an equi-join on the indexes that each has longer than 1."""
    shape = broadcast_shapes(*(a.shape for a in arrays))
    ndim = len(shape)
    out: DataFrame | None = None
    have: set[str] = set()
    for n, a in enumerate(sorted(enumerate(arrays), key=lambda x: -x[1].size)):
        k, a = a
        lead = ndim - a.ndim
        keep = [j for j in range(a.ndim) if not (a.shape[j] == 1 != shape[j + lead])]
        df = a.df.select(*(F.col(axis_name(j)).alias(axis_name(j + lead)) for j in keep), F.col("v").alias(f"v{k}"))
        names = {axis_name(j + lead) for j in keep}
        common = sorted(have & names)
        out = df if out is None else out.join(df, common) if common else out.crossJoin(df)
        have |= names
    return Array(out.select(*(axis_name(k) for k in range(ndim)), f(*(F.col(f"v{k}") for k in range(len(arrays)))).alias("v")), shape)


def concatenate(arrays: Sequence[Array], axis: int = 0) -> Array:
    axis, at, parts = arrays[0].axis(axis), 0, []
    for a in arrays:
        parts.append(a.relabel(_columns(a) | {axis_name(axis): F.col(axis_name(axis)) + at}, a.shape).df)
        at += a.shape[axis]
    return Array(concat_frames(parts), tuple(at if k == axis else n for k, n in enumerate(arrays[0].shape)))


concat = concatenate


def stack(arrays: Sequence[Array], axis: int = 0) -> Array:
    return concatenate([expand_dims(a, axis) for a in arrays], axis % (arrays[0].ndim + 1))


def vstack(arrays: Sequence[Array]) -> Array:
    return concatenate([atleast_2d(a) for a in arrays], 0)


row_stack = vstack


def hstack(arrays: Sequence[Array]) -> Array:
    return concatenate([atleast_1d(a) for a in arrays], 0 if arrays[0].ndim <= 1 else 1)


def column_stack(arrays: Sequence[Array]) -> Array:
    return concatenate([expand_dims(a, 1) if a.ndim == 1 else a for a in arrays], 1)


def dstack(arrays: Sequence[Array]) -> Array:
    return concatenate([atleast_3d(a) for a in arrays], 2)


def block(arrays: Any) -> Array:
    """Nested lists of blocks, the innermost lists side by side."""

    def depth(x: Any) -> int:
        return 1 + depth(x[0]) if isinstance(x, list) else 0

    def build(x: Any, level: int) -> Array:
        return concatenate([build(y, level - 1) for y in x], -level) if isinstance(x, list) else x if x.ndim >= levels else reshape(x, [1] * (levels - x.ndim) + list(x.shape))

    levels = depth(arrays)
    return build(arrays, levels)


def _part(a: Array, axis: int, low: int, high: int) -> Array:
    name = axis_name(axis)
    part = Array(a.df.filter((F.col(name) >= low) & (F.col(name) < high)), a.shape)
    return part.relabel(_columns(a) | {name: F.col(name) - low}, [high - low if k == axis else n for k, n in enumerate(a.shape)])


def array_split(a: Array, sections: int, axis: int = 0) -> list[Array]:
    axis = a.axis(axis)
    each, extra = divmod(a.shape[axis], sections)
    edges = [k * each + min(k, extra) for k in range(sections + 1)]
    return [_part(a, axis, lo, hi) for lo, hi in zip(edges, edges[1:])]


def split(a: Array, sections: int, axis: int = 0) -> list[Array]:
    if a.shape[a.axis(axis)] % sections:
        raise ValueError("the sections are not equal")
    return array_split(a, sections, axis)


def hsplit(a: Array, sections: int) -> list[Array]:
    return split(a, sections, 0 if a.ndim == 1 else 1)


def vsplit(a: Array, sections: int) -> list[Array]:
    return split(a, sections, 0)


def dsplit(a: Array, sections: int) -> list[Array]:
    return split(a, sections, 2)


def unstack(a: Array, axis: int = 0) -> list[Array]:
    axis = a.axis(axis)
    left = [k for k in range(a.ndim) if k != axis]
    return [
        Array(a.df.filter(F.col(axis_name(axis)) == n).select(*(F.col(axis_name(k)).alias(axis_name(j)) for j, k in enumerate(left)), "v"), tuple(a.shape[k] for k in left)) for n in range(a.shape[axis])
    ]


def repeat(a: Array, repeats: int, axis: int | None = None) -> Array:
    if axis is None:
        a, axis = ravel(a), 0
    axis = a.axis(axis)
    name = axis_name(axis)
    df = a.df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))) if repeats else F.explode(F.array().cast("array<int>")))
    out = Array(df, a.shape)
    return out.relabel(_columns(a) | {name: F.col(name) * repeats + F.col("__r")}, [n * repeats if k == axis else n for k, n in enumerate(a.shape)])


def tile(a: Array, reps: int | Sequence[int]) -> Array:
    reps = [reps] if isinstance(reps, int) else list(reps)
    while a.ndim < len(reps):
        a = expand_dims(a, 0)
    reps = [1] * (a.ndim - len(reps)) + reps
    df, columns = a.df, {}
    for k, r in enumerate(reps):
        df = df.withColumn(f"__r{k}", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
        columns[axis_name(k)] = F.col(axis_name(k)) + F.col(f"__r{k}") * a.shape[k]
    return Array(df, a.shape).relabel(columns, [n * r for n, r in zip(a.shape, reps)])


def append(a: Array, values: Array, axis: int | None = None) -> Array:
    return concatenate([ravel(a), ravel(values)]) if axis is None else concatenate([a, values], axis)


def insert(a: Array, index: int, values: Array, axis: int | None = None) -> Array:
    if axis is None:
        a, values, axis = ravel(a), ravel(values), 0
    axis = a.axis(axis)
    at = index + a.shape[axis] if index < 0 else index
    return concatenate([_part(a, axis, 0, at), values, _part(a, axis, at, a.shape[axis])], axis)


def delete(a: Array, index: int, axis: int | None = None) -> Array:
    if axis is None:
        a, axis = ravel(a), 0
    axis = a.axis(axis)
    at = index + a.shape[axis] if index < 0 else index
    return concatenate([_part(a, axis, 0, at), _part(a, axis, at + 1, a.shape[axis])], axis)


def resize(a: Array, shape: Sequence[int]) -> Array:
    """Repeat or cut the flattened array."""
    size = math.prod(shape)
    flat = tile(ravel(a), max(1, -(-size // max(1, a.size))))
    return reshape(_part(flat, 0, 0, size), shape)


def pad(a: Array, width: int | Sequence[tuple[int, int]], mode: str = "constant", constant_values: float = 0.0) -> Array:
    """Constant or edge padding."""
    widths = [(width, width)] * a.ndim if isinstance(width, int) else list(width)
    shape = [n + lo + hi for n, (lo, hi) in zip(a.shape, widths)]
    every = grid(a.df.sparkSession, shape).df.drop("v")
    source = [F.col(x) - lo for x, (lo, _) in zip(a.axes, widths)]
    if mode == "edge":
        source = [F.greatest(F.lit(0), F.least(F.lit(n - 1), s)) for s, n in zip(source, a.shape)]
    elif mode != "constant":
        raise ValueError(f"no mode {mode}")
    keyed = every.withColumns({f"__{x}": s.cast("bigint") for x, s in zip(a.axes, source)})
    inner = a.df.select(*(F.col(x).alias(f"__{x}") for x in a.axes), "v")
    out = keyed.join(inner, [f"__{x}" for x in a.axes], "left").select(*a.axes, F.coalesce("v", F.lit(constant_values)).alias("v"))
    return Array(out, tuple(shape))


def diagonal(a: Array, k: int = 0) -> Array:
    n = max(0, min(a.shape[0], a.shape[1] - k) if k >= 0 else min(a.shape[0] + k, a.shape[1]))
    df = a.df.filter(F.col("i1") == F.col("i0") + k).withColumn("__d", F.least("i0", "i1"))
    rest = list(range(2, a.ndim))
    columns = {axis_name(j): F.col(axis_name(r)) for j, r in enumerate(rest)} | {axis_name(len(rest)): F.col("__d")}
    return Array(df, a.shape).relabel(columns, [*(a.shape[r] for r in rest), n])


def diagflat(a: Array, k: int = 0) -> Array:
    """A matrix with the flattened array on a diagonal."""
    flat = ravel(a)
    n = flat.shape[0] + abs(k)
    cells = flat.df.select((F.col("i0") + max(-k, 0)).alias("i0"), (F.col("i0") + max(k, 0)).alias("i1"), "v")
    out = grid(a.df.sparkSession, (n, n)).df.drop("v").join(cells, ["i0", "i1"], "left").fillna(0, subset=["v"])
    return Array(out, (n, n))


def diag(a: Array, k: int = 0) -> Array:
    return diagflat(a, k) if a.ndim == 1 else diagonal(a, k)


def tril(a: Array, k: int = 0) -> Array:
    return a.map(lambda v: F.when(F.col("i1") <= F.col("i0") + k, v).otherwise(F.lit(0).cast(a.dtype)))


def triu(a: Array, k: int = 0) -> Array:
    return a.map(lambda v: F.when(F.col("i1") >= F.col("i0") + k, v).otherwise(F.lit(0).cast(a.dtype)))


# selection


def take(a: Array, indices: Array, axis: int | None = None) -> Array:
    """Gather along an axis (or from the flattened array): an equi-join with the index array."""
    if axis is None:
        flat, wanted = ravel(a), indices.df.select(*indices.axes, F.pmod("v", F.lit(a.size)).alias("__at"))
        out = wanted.join(flat.df.withColumnRenamed("i0", "__at"), "__at")
        return Array(out.select(*indices.axes, "v"), indices.shape)
    axis = a.axis(axis)
    name = axis_name(axis)
    wanted = indices.df.select(F.col("i0").alias("__to"), F.pmod("v", F.lit(a.shape[axis])).alias(name))
    out = a.df.join(wanted, name)
    return Array(out, a.shape).relabel(_columns(a) | {name: F.col("__to")}, [indices.shape[0] if k == axis else n for k, n in enumerate(a.shape)])


def take_along_axis(a: Array, indices: Array, axis: int) -> Array:
    name = axis_name(a.axis(axis))
    wanted = indices.df.withColumnRenamed(name, "__to").withColumnRenamed("v", name)
    return Array(a.df.join(wanted, a.axes), indices.shape).relabel(_columns(a) | {name: F.col("__to")}, indices.shape)


def put(a: Array, indices: Array, values: Array) -> Array:
    """a.flat[indices] = values, the values repeating."""
    n = values.size
    # of a repeated index the last value counts
    last = indices.df.select(F.pmod("v", F.lit(a.size)).alias("__flat"), "i0").groupBy("__flat").agg(F.max("i0").alias("i0"))
    new = last.select("__flat", F.pmod("i0", F.lit(n)).alias("__k"))
    new = new.join(ravel(values).df.select(F.col("i0").alias("__k"), F.col("v").alias("__new")), "__k").select("__flat", "__new")
    out = a.df.withColumn("__flat", a.flat()).join(new, "__flat", "left")
    return Array(out.select(*a.axes, F.coalesce("__new", "v").alias("v")), a.shape)


def put_along_axis(a: Array, indices: Array, values: Array, axis: int) -> Array:
    name = axis_name(a.axis(axis))
    # of a repeated index the last value along the axis counts
    asked = indices.df.withColumnRenamed("v", "__at").join(values.df.withColumnRenamed("v", "__new"), a.axes)
    others = [x for x in a.axes if x != name]
    new = asked.groupBy(*others, F.pmod("__at", F.lit(a.shape[a.axis(axis)])).alias("__to")).agg(F.max_by("__new", name).alias("__new")).withColumnRenamed("__to", name)
    return Array(a.df.join(new, a.axes, "left").select(*a.axes, F.coalesce("__new", "v").alias("v")), a.shape)


def compress(condition: Array, a: Array, axis: int | None = None) -> Array:
    """Slices where a 1-D condition holds, numbered anew."""
    if axis is None:
        a, axis = ravel(a), 0
    axis = a.axis(axis)
    name = axis_name(axis)
    kept = number_rows(condition.df.filter(F.col("v").cast("boolean")).select(F.col("i0").alias(name)), [name], "__to")
    n = kept.count()
    return Array(a.df.join(kept, name), a.shape).relabel(_columns(a) | {name: F.col("__to")}, [n if k == axis else m for k, m in enumerate(a.shape)])


def extract(condition: Array, a: Array) -> Array:
    return compress(ravel(condition), ravel(a))


def argwhere(a: Array) -> DataFrame:
    """The index columns of nonzero elements."""
    return a.df.filter(F.col("v").cast("double") != 0).select(*a.axes)


nonzero = argwhere


def flatnonzero(a: Array) -> DataFrame:
    return a.df.filter(F.col("v").cast("double") != 0).select(a.flat().alias("v"))


def where(condition: Any, x: Any, y: Any) -> Column:
    return F.when(condition, x).otherwise(y)


def select(conditions: Sequence[Column], choices: Sequence[Any], default: Any = 0.0) -> Column:
    """The choice of the first condition that holds."""
    return reduce(lambda out, cv: F.when(cv[0], cv[1]).otherwise(out), reversed(list(zip(conditions, choices))), F.lit(default) if not isinstance(default, Column) else default)


def piecewise(x: Column, conditions: Sequence[Column], functions: Sequence[Any]) -> Column:
    """The last condition that holds decides; one more function is the default."""
    value = lambda f: f(x) if callable(f) else F.lit(f)
    out = value(functions[len(conditions)]) if len(functions) > len(conditions) else F.lit(0.0)
    for condition, f in zip(conditions, functions):
        out = F.when(condition, value(f)).otherwise(out)
    return out


def choose(selector: Any, choices: Sequence[Any]) -> Column:
    at = F.col(selector) if isinstance(selector, str) else selector
    return F.element_at(F.array(*choices), at.cast("int") + 1)


def copyto(old: Any, new: Any, mask: Any) -> Column:
    return F.when(mask, new).otherwise(old)


def putmask(a: Array, mask: Callable[[Column], Column], values: Sequence[float]) -> Array:
    """Where the mask holds, values by position, repeating."""
    at = F.pmod(a.flat(), F.lit(len(values))).cast("int") + 1
    return a.map(lambda v: F.when(mask(v), F.element_at(F.array(*(F.lit(x) for x in values)), at)).otherwise(v))


def place(a: Array, mask: Callable[[Column], Column], values: Sequence[float]) -> Array:
    """Where the mask holds, the values one after another, repeating."""
    flat = a.df.withColumn("__flat", a.flat())
    hit = number_rows(flat.filter(mask(F.col("v"))).select("__flat"), ["__flat"], "__k")
    new = hit.withColumn("__new", F.element_at(F.array(*(F.lit(x) for x in values)), F.pmod("__k", F.lit(len(values))).cast("int") + 1)).drop("__k")
    return Array(flat.join(new, "__flat", "left").select(*a.axes, F.coalesce("__new", "v").alias("v")), a.shape)


def fill_diagonal(a: Array, value: float, wrap: bool = False) -> Array:
    step = sum(math.prod(a.shape[k + 1 :]) for k in range(a.ndim))
    if a.ndim == 2 and not wrap:
        on = F.col("i0") == F.col("i1")
    elif a.ndim == 2:
        on = a.flat() % (a.shape[1] + 1) == 0
    else:
        on = a.flat() % step == 0
    return a.map(lambda v: F.when(on, F.lit(value)).otherwise(v))


def trim_zeros(a: Array, trim: str = "fb") -> Array:
    low, high = a.df.filter(F.col("v") != 0).agg(F.min("i0"), F.max("i0")).first()
    if low is None:
        return _part(a, 0, 0, 0)
    return _part(a, 0, low if "f" in trim.lower() else 0, high + 1 if "b" in trim.lower() else a.shape[0])


def unravel_index(flat: Column, shape: Sequence[int], order: str = "C") -> list[Column]:
    return unravel(flat, shape) if order == "C" else list(reversed(unravel(flat, list(reversed(shape)))))


def ravel_multi_index(indexes: Sequence[Column], dims: Sequence[int], mode: str = "raise", order: str = "C") -> Column:
    out = F.lit(0).cast("bigint")
    for c, n in zip(indexes, dims) if order == "C" else reversed(list(zip(indexes, dims))):
        if mode == "wrap":
            c = F.pmod(c, F.lit(n))
        elif mode == "clip":
            c = F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
        else:
            c = F.when((c < 0) | (c >= n), F.raise_error(F.lit("index out of bounds")).cast("bigint")).otherwise(c)
        out = out * n + c
    return out


# index builders and generators


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1) -> Array:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, math.ceil((stop - start) / step))
    return Array(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") * step + start).alias("v")), (n,))


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50) -> Array:
    step = (stop - start) / max(1, num - 1)
    value = F.when(F.col("id") == num - 1, F.lit(float(stop))).otherwise(F.col("id") * step + start) if num > 1 else F.lit(float(start))
    return Array(spark.range(num).select(F.col("id").alias("i0"), value.alias("v")), (num,))


def logspace(spark: SparkSession, start: float, stop: float, num: int = 50, base: float = 10.0) -> Array:
    return linspace(spark, start, stop, num).map(lambda v: F.pow(F.lit(float(base)), v))


def geomspace(spark: SparkSession, start: float, stop: float, num: int = 50) -> Array:
    if start * stop <= 0:
        raise ValueError("the ends need one sign and must not be zero")
    sign = 1.0 if start > 0 else -1.0
    return linspace(spark, math.log(abs(start)), math.log(abs(stop)), num).map(lambda v: F.exp(v) * sign)


def full(spark: SparkSession, shape: int | Sequence[int], value: Any) -> Array:
    return grid(spark, [shape] if isinstance(shape, int) else shape).map(lambda v: F.lit(value))


def zeros(spark: SparkSession, shape: int | Sequence[int], dtype: str = "double") -> Array:
    return full(spark, shape, F.lit(0).cast(dtype))


empty = zeros


def ones(spark: SparkSession, shape: int | Sequence[int], dtype: str = "double") -> Array:
    return full(spark, shape, F.lit(1).cast(dtype))


def full_like(a: Array, value: Any) -> Array:
    return a.map(lambda v: F.lit(value).cast(a.dtype))


def zeros_like(a: Array) -> Array:
    return full_like(a, 0)


empty_like = zeros_like


def ones_like(a: Array) -> Array:
    return full_like(a, 1)


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> Array:
    return grid(spark, (n, n if m is None else m)).map(lambda v: (F.col("i1") <= F.col("i0") + k).cast("double"))


def eye(spark: SparkSession, n: int) -> Array:
    return grid(spark, (n, n)).map(lambda v: (F.col("i0") == F.col("i1")).cast("double"))


identity = eye


def indices(spark: SparkSession, shape: Sequence[int]) -> Array:
    """An array of index grids, one for each axis in front."""
    g = grid(spark, shape)
    return stack([g.map(lambda v, x=x: F.col(x)) for x in g.axes])


def meshgrid(*xs: Array, indexing: str = "xy") -> list[Array]:
    order = [1, 0, *range(2, len(xs))] if indexing == "xy" and len(xs) > 1 else list(range(len(xs)))
    shape = [xs[k].shape[0] for k in order]
    return [broadcast_to(reshape(x, [x.shape[0] if order[k] == n else 1 for k in range(len(xs))]), shape) for n, x in enumerate(xs)]


def ix_(*xs: Array) -> list[Array]:
    return [reshape(x, [x.shape[0] if k == n else 1 for k in range(len(xs))]) for n, x in enumerate(xs)]


class _Grid:
    """``mgrid(spark)[0:3, 1:2:5j]``: a dense grid of each axis, or with ``sparse`` one array of broadcastable length for each."""

    def __init__(self, sparse: bool) -> None:
        self.sparse = sparse

    def __call__(self, spark: SparkSession) -> _Ranges:
        return _Ranges(spark, self.sparse)


class _Ranges:
    def __init__(self, spark: SparkSession, sparse: bool) -> None:
        self.spark, self.sparse = spark, sparse

    def _one(self, key: slice) -> Array:
        start, step = key.start or 0, 1 if key.step is None else key.step
        return linspace(self.spark, start, key.stop, int(abs(step))) if isinstance(step, complex) else arange(self.spark, start, key.stop, step)

    def __getitem__(self, key: slice | tuple[slice, ...]) -> Array | list[Array]:
        if isinstance(key, slice):
            return self._one(key)
        apart = ix_(*(self._one(k) for k in key))
        return apart if self.sparse else stack(broadcast_arrays(*apart))


mgrid, ogrid = _Grid(False), _Grid(True)


def diag_indices(spark: SparkSession, n: int, ndim: int = 2) -> DataFrame:
    return spark.range(n).select(*(F.col("id").alias(axis_name(k)) for k in range(ndim)))


def tril_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return grid(spark, (n, m or n)).df.filter(F.col("i1") <= F.col("i0") + k).select("i0", "i1")


def triu_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return grid(spark, (n, m or n)).df.filter(F.col("i1") >= F.col("i0") + k).select("i0", "i1")


def diag_indices_from(a: Array) -> DataFrame:
    return diag_indices(a.df.sparkSession, min(a.shape), a.ndim)


def tril_indices_from(a: Array, k: int = 0) -> DataFrame:
    return tril_indices(a.df.sparkSession, a.shape[0], k, a.shape[1])


def triu_indices_from(a: Array, k: int = 0) -> DataFrame:
    return triu_indices(a.df.sparkSession, a.shape[0], k, a.shape[1])


def mask_indices(spark: SparkSession, n: int, mask: Callable[[Array, int], Array], k: int = 0) -> DataFrame:
    return argwhere(mask(ones(spark, (n, n)), k))


def ndenumerate(a: Array):
    """(index, value) pairs in row-major order, streamed to the driver."""
    for row in a.df.orderBy(*a.axes).toLocalIterator():
        yield tuple(row[x] for x in a.axes), row["v"]


def ndindex(*shape: int):
    from itertools import product

    return product(*(range(n) for n in shape))


# tapers


def _taper(spark: SparkSession, m: int, f: Callable[[Column], Column]) -> Array:
    if m == 1:
        return ones(spark, 1)
    return Array(spark.range(m).select(F.col("id").alias("i0"), f(F.col("id").cast("double")).alias("v")), (m,))


def bartlett(spark: SparkSession, m: int) -> Array:
    half = (m - 1) / 2
    return _taper(spark, m, lambda k: 1 - F.abs(k - half) / half)


def hanning(spark: SparkSession, m: int) -> Array:
    return _taper(spark, m, lambda k: 0.5 - 0.5 * F.cos(2 * math.pi * k / (m - 1)))


def hamming(spark: SparkSession, m: int) -> Array:
    return _taper(spark, m, lambda k: 0.54 - 0.46 * F.cos(2 * math.pi * k / (m - 1)))


def blackman(spark: SparkSession, m: int) -> Array:
    return _taper(spark, m, lambda k: 0.42 - 0.5 * F.cos(2 * math.pi * k / (m - 1)) + 0.08 * F.cos(4 * math.pi * k / (m - 1)))


def kaiser(spark: SparkSession, m: int, beta: float) -> Array:
    from ..functions.math import i0

    half = (m - 1) / 2
    return _taper(spark, m, lambda k: i0(beta * F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow((k - half) / half, F.lit(2.0))))) / i0(F.lit(float(beta))))
