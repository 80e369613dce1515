"""Operators, indexing and methods of :class:`gridloom.arrays.Array`.

Importing this module gives arrays their arithmetic (``a + b``, ``a @ b``, ``a > 2``),
indexing (``a[1:, ::-1]``, ``a[mask]``) and the usual methods (``a.sum(0)``,
``a.reshape(2, -1)``, ``a.T``). All of them build plans; ``item``, ``tolist`` and
``collect`` run them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from .arrays import Array, array, axis_name
from .functions import bits, dtypes, math as m, predicates as p
from .operators import linalg, reductions as r, shape, sorting, windows



def _binary(f, swapped: bool = False):
    def apply(self: Array, other: Any) -> Array:
        g = (lambda a, b: f(b, a)) if swapped else f
        if isinstance(other, Array):
            return shape.elementwise(g, self, other)
        return self.map(lambda v: g(v, F.lit(other)))

    return apply


def _integers(a: Array) -> bool:
    return a.dtype in ("tinyint", "smallint", "int", "bigint")


def _reflected(f):
    """The form with a plain number on the left."""
    return lambda self, other: self.map(lambda v: f(F.lit(other), v, integers=_integers(self) and isinstance(other, int)))


def _floor_divide(self: Array, other: Any) -> Array:
    whole = _integers(self) and (_integers(other) if isinstance(other, Array) else isinstance(other, int))
    return _binary(lambda a, b: m.floor_divide(a, b, integers=whole))(self, other)


def _remainder(self: Array, other: Any) -> Array:
    whole = _integers(self) and (_integers(other) if isinstance(other, Array) else isinstance(other, int))
    return _binary(lambda a, b: m.remainder(a, b, integers=whole))(self, other)


for _name, _f in {
    "add": m.add, "sub": m.subtract, "mul": m.multiply, "truediv": m.divide, "pow": m.power, "and": bits.bitwise_and, "or": bits.bitwise_or,
    "xor": bits.bitwise_xor, "lshift": bits.left_shift, "rshift": bits.right_shift,
}.items():
    setattr(Array, f"__{_name}__", _binary(_f))
    setattr(Array, f"__r{_name}__", _binary(_f, swapped=True))
for _name, _f in {"eq": p.equal, "ne": p.not_equal, "lt": p.less, "le": p.less_equal, "gt": p.greater, "ge": p.greater_equal}.items():
    setattr(Array, f"__{_name}__", _binary(_f))
Array.__hash__ = object.__hash__
Array.__floordiv__, Array.__mod__ = _floor_divide, _remainder
Array.__rfloordiv__, Array.__rmod__ = _reflected(m.floor_divide), _reflected(m.remainder)
Array.__divmod__ = lambda self, other: (_floor_divide(self, other), _remainder(self, other))
Array.__neg__ = lambda self: self.map(m.negative)
Array.__pos__ = lambda self: self.map(m.positive)
Array.__abs__ = lambda self: self.map(m.abs)
Array.__invert__ = lambda self: self.map(lambda v: ~v if self.dtype == "boolean" else bits.invert(v))
Array.__matmul__ = linalg.matmul
Array.__rmatmul__ = lambda self, other: linalg.matmul(array(self.df.sparkSession, other), self)
Array.__len__ = lambda self: self.shape[0]


def _get(self: Array, key: Any) -> Array:
    """Integers, slices (any step), ``None``, ``...`` and boolean masks."""
    if isinstance(key, Array):
        if key.dtype != "boolean":
            return shape.take(self, key, 0)
        return shape.compress(key, self, 0) if key.ndim == 1 else shape.extract(key, self)
    keys = list(key) if isinstance(key, tuple) else [key]
    used = sum(k is not None and k is not Ellipsis for k in keys)
    if used > self.ndim:
        raise IndexError(f"too many indices for {self.ndim} dimensions")
    if Ellipsis not in keys:
        keys.append(Ellipsis)
    at = keys.index(Ellipsis)
    keys[at : at + 1] = [slice(None)] * (self.ndim - used)
    df, columns, sizes, axis = self.df, [], [], 0
    for k in keys:
        if k is None:
            columns.append(F.lit(0))
            sizes.append(1)
            continue
        name, n = axis_name(axis), self.shape[axis]
        axis += 1
        if isinstance(k, slice):
            start, stop, step = k.indices(n)
            count = len(range(start, stop, step))
            place = (F.col(name) - start) / step
            df = df.filter((place == F.floor(place)) & (place >= 0) & (place < count))
            columns.append(F.floor(place))
            sizes.append(count)
        else:
            if not -n <= k < n:
                raise IndexError(f"index {k} is out of bounds for {n} elements")
            df = df.filter(F.col(name) == k % n)
    out = [c.cast("bigint").alias(f"__i{j}") for j, c in enumerate(columns)]
    picked = df.select(*out, "v").toDF(*(axis_name(j) for j in range(len(columns))), "v")
    return Array(picked, tuple(sizes))


Array.__getitem__ = _get


def assigned(self: Array, key: Any, value: Any) -> Array:
    """What ``a[key] = value`` makes of an array, as a new plan: a number, or an array of the selection's shape."""
    place = "__flat"
    at = _get(Array(self.df.withColumn("v", self.flat()), self.shape), key)
    if isinstance(value, Array):
        if value.shape != at.shape:
            raise ValueError(f"values of shape {value.shape} do not fit a selection of shape {at.shape}")
        given = value.df.withColumnRenamed("v", "__new")
        new = at.df.join(given, at.axes) if at.axes else at.df.crossJoin(given)  # one element and one value
    else:
        new = at.df.withColumn("__new", F.lit(value))
    new = new.select(F.col("v").alias(place), F.col("__new").cast(self.dtype), F.lit(True).alias("__set"))
    both = self.df.withColumn(place, self.flat()).join(new, place, "left")
    return Array(both.select(*self.axes, F.when(F.col("__set"), F.col("__new")).otherwise(F.col("v")).alias("v")), self.shape)


Array.assigned = assigned


def _reduction(f):
    def apply(self: Array, axis: Any = None) -> Array:
        return r.reduce_axes(self, f, axis)

    return apply


for _name in ("sum", "prod", "mean", "var", "std", "max", "min", "ptp", "all", "any", "median"):
    setattr(Array, _name, _reduction(getattr(r, _name)))


def _argument(f):
    def apply(self: Array, axis: int | None = None) -> Array:
        return r.arg_reduce(shape.ravel(self), f, 0) if axis is None else r.arg_reduce(self, f, axis)

    return apply


Array.skew, Array.kurtosis = _reduction(r.skew), _reduction(r.kurtosis)
Array.moment = r.moment
Array.argmax, Array.argmin = _argument(r.argmax), _argument(r.argmin)
for _module, _names in (
    (shape, "transpose swapaxes ravel flatten squeeze repeat diagonal take compress put choose fill_diagonal"),
    (windows, "cumsum cumprod diff"),
    (sorting, "sort argsort partition argpartition"),
    (linalg, "dot trace inner"),
    (dtypes, "astype copy"),
):
    for _name in _names.split():
        setattr(Array, _name, getattr(_module, _name))
Array.transpose = lambda self, *axes: shape.transpose(self, axes[0] if len(axes) == 1 and not isinstance(axes[0], int) else axes or None)
Array.reshape = lambda self, *sizes: shape.reshape(self, sizes[0] if len(sizes) == 1 and not isinstance(sizes[0], int) else sizes)
Array.resize = lambda self, *sizes: shape.resize(self, sizes[0] if len(sizes) == 1 and not isinstance(sizes[0], int) else sizes)
Array.nonzero, Array.argwhere = shape.nonzero, shape.argwhere
Array.clip = lambda self, low=None, high=None: self.map(lambda v: m.clip(v, low, high))
Array.round = lambda self, decimals=0: self.map(lambda v: m.round(v, decimals))
Array.conj = Array.conjugate = lambda self: self.map(lambda v: F.struct(v["re"].alias("re"), (-v["im"]).alias("im"))) if "struct" in self.dtype else self
Array.T = property(shape.transpose)
Array.real = property(lambda self: self.map(lambda v: v["re"]) if "struct" in self.dtype else self)
Array.imag = property(lambda self: self.map(lambda v: v["im"]) if "struct" in self.dtype else shape.zeros_like(self))
Array.itemsize = property(lambda self: {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4}.get(self.dtype, 16 if "struct" in self.dtype else 8))
Array.nbytes = property(lambda self: self.size * self.itemsize)
Array.count_nonzero = lambda self: self.df.agg(r.count_nonzero("v")).first()[0]
Array.searchsorted = lambda self, queries, side="left": sorting.searchsorted_frame(self.df, "v", queries.df, "v", side)
Array.fill = lambda self, value: shape.full_like(self, value)


def item(self: Array, *index: int) -> Any:
    """One element as a Python value."""
    df = self.df
    if len(index) == 1 and self.ndim != 1:
        df = df.filter(self.flat() == index[0] % self.size)
    else:
        for k, i in enumerate(index):
            df = df.filter(F.col(axis_name(k)) == i % self.shape[k])
    rows = df.select("v").take(2)
    if len(rows) != 1:
        raise ValueError("only one element can become a scalar")
    return rows[0][0]


Array.item = item
Array.tobytes = lambda self: self.collect().tobytes()
Array.tolist = lambda self: self.collect().tolist()
Array.__float__ = lambda self: float(item(self))
Array.__int__ = lambda self: int(item(self))
Array.__bool__ = lambda self: bool(item(self))


def array_equal(a: Array, b: Array) -> bool:
    """Whether shapes agree and all elements are equal; NaN equals nothing."""
    if a.shape != b.shape:
        return False
    other = b.df.withColumnRenamed("v", "w")
    alike = p.equal("v", "w") if a.dtype != "string" else F.col("v") == F.col("w")
    both = a.df.join(other, a.axes, "full") if a.axes else a.df.crossJoin(other)
    return both.agg(F.coalesce(F.bool_and(F.coalesce(alike, F.lit(False))), F.lit(True))).first()[0]


def allclose(a: Array, b: Array, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    if a.shape != b.shape:
        return False
    both = a.df.join(b.df.withColumnRenamed("v", "w"), a.axes)
    return both.agg(p.allclose("v", "w", rtol, atol)).first()[0]
