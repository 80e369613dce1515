"""Linear algebra: contractions are joins and aggregations, factorisations are per matrix.

Products of any size run as an equi-join on the contracted index and a grouped sum.
Dense factorisations (LU, QR, SVD, eigenvalues) have no relational form: a batch of
small matrices, one for each value of the batch columns, goes through
``applyInArrow`` by batch; a single tall matrix is reduced to its Gram matrix by one
aggregation first (:func:`lstsq`, :func:`svdvals_tall`, :func:`qr_tall`). One square
matrix with a side of over ``SIDE`` goes by tiles (:mod:`blocked`) for ``solve``,
``inv``, ``det``, ``slogdet`` and ``cholesky``; a longer one with few columns by
triangular factors (:mod:`tall`) for singular values, condition and rank. Leading pairs
of matrices of any size are in :mod:`leading`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..arrays import Array, axis_name, array
from . import blocked, leading, tall, tiles
from .shape import diagonal, elementwise, reshape


#: What dense factorisations raise for a singular matrix.
LinAlgError = np.linalg.LinAlgError


def einsum(subscripts: str, *operands: Array) -> Array:
    """Einstein summation: joins on shared letters, then one grouped sum.

    Operands are contracted two at a time in the order of :func:`einsum_path`; a letter
    needed neither by the others nor in the result is summed away at once.
    """
    inputs, _, output = subscripts.replace(" ", "").partition("->")
    terms = inputs.split(",")
    name = lambda x: f"l{ord(x)}"  # noqa: E731  column names ignore case, letters do not
    if "->" not in subscripts:
        letters = inputs.replace(",", "")
        output = "".join(sorted(x for x in set(letters) if letters.count(x) == 1))
    sizes = {x: n for t, a in zip(terms, operands) for x, n in zip(t, a.shape)}

    def frame(term: str, a: Array) -> DataFrame:
        df = a.df
        for x in set(term):
            at = [k for k, y in enumerate(term) if y == x]
            for k in at[1:]:
                df = df.filter(F.col(axis_name(at[0])) == F.col(axis_name(k)))
        return df.select(*(F.col(axis_name(term.index(x))).alias(name(x)) for x in sorted(set(term))), F.col("v").alias("__v"))

    left = [(frame(t, a), set(t)) for t, a in zip(terms, operands)]

    def reduced(df: DataFrame, have: set[str]) -> tuple[DataFrame, set[str]]:
        needed = set(output).union(*(x for _, x in left))
        if have - needed:
            have &= needed
            df = df.groupBy(*sorted(map(name, have))).agg(F.sum("__v").alias("__v"))
        return df, have

    for i, j in einsum_path(subscripts, *operands):
        (nxt, letters), (now, have) = left.pop(max(i, j)), left.pop(min(i, j))
        common = sorted(map(name, have & letters))
        nxt = nxt.withColumnRenamed("__v", "__w")
        now = (now.join(nxt, common) if common else now.crossJoin(nxt)).withColumn("__v", F.col("__v") * F.col("__w")).drop("__w")
        left.append(reduced(now, have | letters))
    now = reduced(*left.pop())[0]
    return Array(now.select(*(F.col(name(x)).alias(axis_name(k)) for k, x in enumerate(output)), F.col("__v").alias("v")), tuple(sizes[x] for x in output))


#: Operands up to which every order is weighed; beyond, the cheapest pair is taken each time.
MOST_OPERANDS = 9


def einsum_path(subscripts: str, *operands: Array) -> list[tuple[int, int]]:
    """Pairs of places to contract, each result going to the end of the list.

    The order has the fewest rows in all joins and sums together, by the sizes of the axes: found over
    all subsets of the operands, or pair by pair for many operands.
    """
    inputs, _, output = subscripts.replace(" ", "").partition("->")
    terms = inputs.split(",")
    if "->" not in subscripts:
        letters = inputs.replace(",", "")
        output = "".join(x for x in set(letters) if letters.count(x) == 1)
    sizes = {x: n for t, a in zip(terms, operands) for x, n in zip(t, a.shape)}
    n = len(terms)

    def rows(letters: frozenset[str]) -> int:
        return math.prod(sizes[x] for x in letters)

    def kept(members: int) -> frozenset[str]:
        """The letters of a contracted subset that others or the result need."""
        inside = set().union(*(terms[k] for k in range(n) if members >> k & 1))
        outside = set(output).union(*(terms[k] for k in range(n) if not members >> k & 1))
        return frozenset(inside & outside if members & (members - 1) else inside)

    def cost(a: int, b: int) -> int:
        return rows(kept(a) | kept(b)) + rows(kept(a | b))

    if n <= MOST_OPERANDS:
        best: dict[int, tuple[int, list]] = {1 << k: (0, []) for k in range(n)}
        for members in sorted(range(1, 1 << n), key=int.bit_count):
            part = (members - 1) & members
            while part:
                other = members ^ part
                if part > other:  # each split once
                    total = best[part][0] + best[other][0] + cost(part, other)
                    if members not in best or total < best[members][0]:
                        best[members] = (total, [*best[other][1], *best[part][1], (other, part)])
                part = (part - 1) & members
        steps = best[(1 << n) - 1][1]
    else:
        now, steps = [1 << k for k in range(n)], []
        while len(now) > 1:
            a, b = min(((x, y) for k, x in enumerate(now) for y in now[k + 1 :]), key=lambda p: cost(*p))
            now = [x for x in now if x not in (a, b)] + [a | b]
            steps.append((a, b))
    now, path = [1 << k for k in range(n)], []
    for a, b in steps:
        i, j = sorted((now.index(a), now.index(b)))
        path.append((i, j))
        now = [x for x in now if x not in (a, b)] + [a | b]
    return path


#: Products of scalars from which a matrix product goes by tiles.
TILED = 1 << 24


def matmul(a: Array, b: Array) -> Array:
    if a.ndim == b.ndim == 1:
        return einsum("a,a->", a, b)
    if a.ndim == 1:
        return einsum("a,ab->b", a, b)
    if b.ndim == 1:
        return einsum("ab,b->a", a, b)
    if a.shape[-1] != b.shape[-2]:
        raise ValueError(f"cannot multiply {a.shape} by {b.shape}")
    if a.ndim == b.ndim == 2 and a.shape[0] * a.shape[1] * b.shape[1] >= TILED and {a.dtype, b.dtype} <= {"double", "float"}:
        return tiles.matmul(a, b)
    batch = "cdefgh"[: max(a.ndim, b.ndim) - 2]
    return einsum(f"{batch[len(batch) - a.ndim + 2 :]}ij,{batch[len(batch) - b.ndim + 2 :]}jk->{batch}ik", a, b)


def dot(a: Array, b: Array) -> Array:
    if a.ndim == 0 or b.ndim == 0:
        return elementwise(lambda x, y: x * y, a, b)
    return matmul(a, b)


def inner(a: Array, b: Array) -> Array:
    """Sum over the last axis, the others matched."""
    letters = "abcdef"[: max(a.ndim, b.ndim)]
    return einsum(f"{letters[-a.ndim :]},{letters[-b.ndim :]}->{letters[:-1]}", a, b)


def outer(a: Array, b: Array) -> Array:
    return einsum("a,b->ab", reshape(a, [-1]), reshape(b, [-1]))


def vdot(a: Array, b: Array) -> Array:
    return einsum("a,a->", reshape(a, [-1]), reshape(b, [-1]))


def trace(a: Array) -> Array:
    return Array(diagonal(a).df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")), ())


def kron(a: Array, b: Array) -> Array:
    ndim = max(a.ndim, b.ndim)
    a, b = (reshape(x, [1] * (ndim - x.ndim) + list(x.shape)) for x in (a, b))
    other = b.df.select(*(F.col(x).alias(f"__{x}") for x in b.axes), F.col("v").alias("__v"))
    shape = tuple(m * n for m, n in zip(a.shape, b.shape))
    cells = [(F.col(axis_name(k)) * b.shape[k] + F.col(f"__i{k}")).alias(axis_name(k)) for k in range(ndim)]
    return Array(a.df.crossJoin(other).select(*cells, (F.col("v") * F.col("__v")).alias("v")), shape)


def cross(a: Array, b: Array) -> Array:
    """Cross product of rows of 3 elements, from two grouped pivots."""

    def wide(x: Array, p: str) -> DataFrame:
        last, lead = x.axes[-1], x.axes[:-1]
        return x.df.groupBy(*lead).agg(*(F.sum(F.when(F.col(last) == k, F.col("v"))).alias(f"{p}{k}") for k in range(3)))

    lead = a.axes[:-1]
    both = wide(a, "a").join(wide(b, "b"), lead) if lead else wide(a, "a").crossJoin(wide(b, "b"))
    c = F.col
    cells = [c("a1") * c("b2") - c("a2") * c("b1"), c("a2") * c("b0") - c("a0") * c("b2"), c("a0") * c("b1") - c("a1") * c("b0")]
    out = both.select(*lead, F.posexplode(F.array(*cells)).alias("__k", "v"))
    return Array(out.select(*lead, c("__k").cast("bigint").alias(a.axes[-1]), "v"), a.shape)


def tensordot(a: Array, b: Array, axes: int | tuple[Sequence[int], Sequence[int]] = 2) -> Array:
    if isinstance(axes, int):
        axes = (list(range(a.ndim - axes, a.ndim)), list(range(axes)))
    left, right = [a.axis(k) for k in axes[0]], [b.axis(k) for k in axes[1]]
    names = [chr(97 + k) for k in range(a.ndim)]
    others = [names[left[right.index(k)]] if k in right else chr(65 + k) for k in range(b.ndim)]
    out = "".join([x for k, x in enumerate(names) if k not in left] + [x for k, x in enumerate(others) if k not in right])
    return einsum(f"{''.join(names)},{''.join(others)}->{out}", a, b)


def matrix_power(a: Array, n: int) -> Array:
    """By repeated squaring; negative powers through the inverse."""
    if n < 0:
        return matrix_power(inv(a), -n)
    out: Array | None = None
    while n:
        if n & 1:
            out = a if out is None else matmul(out, a)
        n >>= 1
        if n:
            a = matmul(a, a)
    return out if out is not None else array(a.df.sparkSession, np.eye(a.shape[0]))


def multi_dot(arrays: Sequence[Array]) -> Array:
    out = arrays[0]
    for b in arrays[1:]:
        out = matmul(out, b)
    return out


# norms


def vector_norm(a: Array, ord: float | None = None) -> Array:  # noqa: A002
    size = F.abs("v")
    if ord is None or ord == 2:
        out = F.sqrt(F.sum(F.col("v") * F.col("v")))
    elif ord == math.inf:
        out = F.max(size)
    elif ord == -math.inf:
        out = F.min(size)
    elif ord == 0:
        out = F.count_if(F.col("v") != 0).cast("double")
    else:
        out = F.pow(F.sum(F.pow(size, F.lit(float(ord)))), F.lit(1.0 / ord))
    return Array(a.df.agg(out.alias("v")), ())


def matrix_norm(a: Array, ord: Any = None) -> Array:  # noqa: A002
    if ord is None or ord == "fro":
        return vector_norm(a)
    if ord in (1, -1, math.inf, -math.inf):
        kept = "i1" if abs(ord) == 1 else "i0"
        sums = a.df.groupBy(kept).agg(F.sum(F.abs("v")).alias("s"))
        return Array(sums.agg((F.max("s") if ord > 0 else F.min("s")).alias("v")), ())
    if ord == 2 and _large(a):
        values = leading.svd(a, 1).values
        return array(a.df.sparkSession, float(values[0]) if len(values) else 0.0)
    values = svdvals(a)
    f = {"nuc": F.sum, 2: F.max, -2: F.min}[ord]
    return Array(values.df.agg(f("v").alias("v")), ())


def norm(a: Array, ord: Any = None) -> Array:  # noqa: A002
    return matrix_norm(a, ord) if a.ndim == 2 and ord is not None else vector_norm(a, ord)


# dense factorisations, a matrix at a time


def per_matrix(df: DataFrame, keys: Sequence[str], shape: tuple[int, ...], f: Callable[[np.ndarray], np.ndarray], ndim: int) -> DataFrame:
    """``f`` of each dense matrix; ``df`` has the key columns, i0, i1, ... and v."""
    axes = [axis_name(k) for k in range(len(shape))]
    kinds = dict(df.dtypes)
    value = "struct<re:double,im:double>" if getattr(f, "complex_", False) else "double"
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{axis_name(k)} bigint" for k in range(ndim)), f"v {value}"])

    def run(table: pa.Table) -> pa.Table:
        dense = np.zeros(shape)
        dense[tuple(table.column(x).to_numpy() for x in axes)] = table.column("v").to_numpy()
        out = np.asarray(f(dense))
        at = np.indices(out.shape).reshape(out.ndim, out.size)
        flat = out.reshape(-1)
        v = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], ["re", "im"]) if value != "double" else pa.array(flat.astype(float))
        columns = [pa.repeat(table.column(k)[0], len(flat)) for k in keys] + [pa.array(x) for x in at] + [v]
        return pa.Table.from_arrays(columns, [*keys, *(axis_name(k) for k in range(ndim)), "v"])

    return df.select(*keys, *axes, F.col("v").cast("double").alias("v")).groupBy(*keys).applyInArrow(run, ddl)


def _dense(f: Callable[[np.ndarray], np.ndarray], out_shape: Callable[[tuple[int, ...]], tuple[int, ...]], complex_: bool = False) -> Callable[[Array], Array]:
    def apply(a: Array) -> Array:
        lead = a.axes[:-2]
        shape = a.shape[-2:]
        df = a.df.select(*(F.col(x).alias(f"b{k}") for k, x in enumerate(lead)), F.col(a.axes[-2]).alias("i0"), F.col(a.axes[-1]).alias("i1"), "v")
        keys = [f"b{k}" for k in range(len(lead))]
        g = lambda m: f(m)
        g.complex_ = complex_
        result = out_shape(shape)
        if not keys:
            df, keys = df.withColumn("b0", F.lit(0).cast("bigint")), ["b0"]
        out = per_matrix(df, keys, shape, g, len(result))
        batch = keys if lead else []
        names = [*batch, *(axis_name(k) for k in range(len(result)))]
        return Array(out.select(*(F.col(x).alias(axis_name(k)) for k, x in enumerate(names)), "v"), (*a.shape[:-2], *result))

    return apply


def _rank(m: np.ndarray) -> np.ndarray:
    return np.asarray(float(np.linalg.matrix_rank(m)))


#: Side of a matrix up to which one task factors it.
SIDE = 2048


def _large(a: Array) -> bool:
    return a.ndim == 2 and a.shape[0] == a.shape[1] > SIDE


def _long(a: Array) -> bool:
    return a.ndim == 2 and a.shape[0] > SIDE >= a.shape[1]


def _by_size(small: Callable[[Array], Array], large: Callable[[Array], Any], which: Callable[[Array], bool] = _large) -> Callable[[Array], Array]:
    def apply(a: Array) -> Array:
        if not which(a):
            return small(a)
        out = large(a)
        return out if isinstance(out, Array) else array(a.df.sparkSession, out)

    return apply


inv = _by_size(_dense(np.linalg.inv, lambda s: s), blocked.inv)
det = _by_size(_dense(lambda m: np.asarray(np.linalg.det(m)), lambda s: ()), blocked.det)
slogdet = _by_size(_dense(lambda m: np.asarray(np.linalg.slogdet(m)), lambda s: (2,)), blocked.slogdet)
cholesky = _by_size(_dense(np.linalg.cholesky, lambda s: s), blocked.cholesky)
pinv = _dense(np.linalg.pinv, lambda s: s[::-1])
eigvalsh = _dense(np.linalg.eigvalsh, lambda s: (s[0],))
svdvals = _by_size(_dense(lambda m: np.linalg.svd(m, compute_uv=False), lambda s: (min(s),)), tall.svdvals, _long)
matrix_rank = _by_size(_dense(_rank, lambda s: ()), lambda a: float(tall.matrix_rank(a)), _long)
cond = _by_size(_dense(lambda m: np.asarray(np.linalg.cond(m)), lambda s: ()), tall.cond, _long)
eigvals = _dense(np.linalg.eigvals, lambda s: (s[0],), complex_=True)


def qr(a: Array) -> tuple[Array, Array]:
    k = min(a.shape[-2:])
    return _dense(lambda m: np.linalg.qr(m)[0], lambda s: (s[0], k))(a), _dense(lambda m: np.linalg.qr(m)[1], lambda s: (k, s[1]))(a)


def svd(a: Array) -> tuple[Array, Array, Array]:
    k = min(a.shape[-2:])
    part = lambda n: lambda m: np.linalg.svd(m, full_matrices=False)[n]
    return _dense(part(0), lambda s: (s[0], k))(a), svdvals(a), _dense(part(2), lambda s: (k, s[1]))(a)


def eigh(a: Array) -> tuple[Array, Array]:
    return eigvalsh(a), _dense(lambda m: np.linalg.eigh(m)[1], lambda s: s)(a)


def eig(a: Array) -> tuple[Array, Array]:
    return eigvals(a), _dense(lambda m: np.linalg.eig(m)[1], lambda s: s, complex_=True)(a)


def solve(a: Array, b: Array) -> Array:
    """a x = b for one matrix: the right sides ride along as extra columns."""
    if _large(a):
        return blocked.solve(a, b)
    n, wide = a.shape[-1], b if b.ndim == 2 else reshape(b, [b.shape[0], 1])
    from .shape import concatenate

    both = concatenate([a.map(lambda v: v.cast("double")), wide.map(lambda v: v.cast("double"))], 1)
    out = _dense(lambda m: np.linalg.solve(m[:, :n], m[:, n:]), lambda s: (n, s[1] - n))(both)
    return out if b.ndim == 2 else reshape(out, [n])


def tensorinv(a: Array, ind: int = 2) -> Array:
    lead, rest = a.shape[:ind], a.shape[ind:]
    return reshape(inv(reshape(a, [math.prod(lead), math.prod(rest)])), [*rest, *lead])


def tensorsolve(a: Array, b: Array) -> Array:
    rest = a.shape[b.ndim :]
    return reshape(solve(reshape(a, [b.size, math.prod(rest)]), reshape(b, [b.size])), list(rest))


# tall matrices: one aggregation to a small Gram matrix


def gram(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """X'X of the columns: one aggregation of k(k+1)/2 sums, whose size is fixed by the columns."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*(F.coalesce(F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"]
    return out


def lstsq(a: DataFrame | Array, b: Sequence[str] | Array, target: str | None = None, rcond: float | None = None) -> tuple[np.ndarray, Any, int, np.ndarray]:
    """(solution, residual sum, rank, singular values) of a tall least-squares problem, by a tree of triangular factors.

    Of two arrays, or of a DataFrame with feature columns and a target.
    """
    if isinstance(a, Array):
        return tall.lstsq(a, b, rcond)
    x, residuals, rank, values = tall.lstsq_columns(a, list(b), [target], rcond)
    return x[:, 0], float(residuals[0]), rank, values


def svdvals_tall(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    return np.sqrt(np.clip(np.linalg.eigvalsh(gram(df, names)), 0, None))[::-1]


def qr_tall(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """Q as columns of the same rows, R on the driver: Cholesky of the Gram matrix."""
    r = np.linalg.cholesky(gram(df, names)).T
    back = np.linalg.inv(r)
    q = [sum((F.col(n) * float(back[i, j]) for i, n in enumerate(names)), F.lit(0.0)).alias(f"q{j}") for j in range(len(names))]
    return df.select("*", *q), r
