"""Complex numbers as structs ``<re: double, im: double>``, and math on the complex domain."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, functions as F

from .core import INF, NAN, real as double


def make(re: Any, im: Any = 0.0) -> Column:
    return F.struct(double(re).alias("re"), double(im).alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return make(z["re"], -z["im"])


conjugate = conj


def angle(z: Column, deg: bool = False) -> Column:
    out = F.atan2(z["im"], z["re"])
    return F.degrees(out) if deg else out


def absolute(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a: Column, b: Column) -> Column:
    """NaN parts for a zero divisor."""
    size = b["re"] * b["re"] + b["im"] * b["im"]
    size = F.when(size != 0, size).otherwise(F.lit(NAN))
    return make((a["re"] * b["re"] + a["im"] * b["im"]) / size, (a["im"] * b["re"] - a["re"] * b["im"]) / size)


def total(z: Column) -> Column:
    """An aggregate: the sum."""
    return make(F.sum(z["re"]), F.sum(z["im"]))


def isreal(z: Column) -> Column:
    return z["im"] == 0


def iscomplex(z: Column) -> Column:
    return z["im"] != 0


def real_if_close(z: Column, tol: float = 100.0) -> Column:
    """An aggregate test: whether every imaginary part is within ``tol`` machine epsilons of 0."""
    return F.max(F.abs(z["im"])) < tol * 2.220446049250313e-16


# the complex domain: real arguments, complex results


def sqrt(x: Any) -> Column:
    x = double(x)
    root = F.sqrt(F.abs(x))
    return make(F.when(x < 0, F.lit(0.0)).otherwise(root), F.when(x < 0, root).otherwise(F.lit(0.0)))


def log(x: Any, base: float = math.e) -> Column:
    """Natural logarithm, or that to a base; -inf at 0."""
    x, scale = double(x), math.log(base)
    size = F.abs(x)
    re = F.when(size > 0, F.ln(F.when(size > 0, size)) / scale).when(size == 0, F.lit(-INF)).otherwise(F.lit(NAN))
    return make(re, F.when(x < 0, F.lit(math.pi / scale)).otherwise(F.lit(0.0)))


def log2(x: Any) -> Column:
    return log(x, 2.0)


def log10(x: Any) -> Column:
    return log(x, 10.0)


def logn(n: float, x: Any) -> Column:
    return log(x, n) if n > 0 else divide(log(x), log(F.lit(float(n))))


def power(x: Any, p: Any) -> Column:
    """|x|**p turned by p times the angle of x."""
    x, p = double(x), double(p)
    size, turn = F.pow(F.abs(x), p), F.when(x < 0, p * math.pi).otherwise(F.lit(0.0))
    whole = p == F.floor(p)
    odd = F.pmod(p, F.lit(2.0)) == 1
    re = F.when(x >= 0, size).when(whole, F.when(odd, -size).otherwise(size)).otherwise(size * F.cos(turn))
    return make(re, F.when((x >= 0) | whole, F.lit(0.0)).otherwise(size * F.sin(turn)))


def arccos(x: Any) -> Column:
    """Outside [-1, 1] the principal value has an imaginary part."""
    x = double(x)
    far = F.acosh(F.abs(x))
    re = F.when(x > 1, F.lit(0.0)).when(x < -1, F.lit(math.pi)).otherwise(F.acos(x))
    return make(re, F.when(x > 1, far).when(x < -1, -far).otherwise(F.lit(0.0)))


def arcsin(x: Any) -> Column:
    x = double(x)
    far = F.acosh(F.abs(x))
    re = F.when(x > 1, F.lit(math.pi / 2)).when(x < -1, F.lit(-math.pi / 2)).otherwise(F.asin(x))
    return make(re, F.when(x > 1, far).when(x < -1, -far).otherwise(F.lit(0.0)))


def arctanh(x: Any) -> Column:
    x = double(x)
    inside = F.abs(x) <= 1
    outside = F.ln(F.abs((1 + x) / F.when(x != 1, 1 - x))) / 2
    return make(F.when(inside, F.atanh(x)).otherwise(outside), F.when(x > 1, F.lit(math.pi / 2)).when(x < -1, F.lit(-math.pi / 2)).otherwise(F.lit(0.0)))
