"""Element-wise math on Columns.

Every function takes Columns, column names or scalars and returns a Column, so a
chain of them is one projection inside whole-stage code generation. Domains follow
IEEE arithmetic where Spark would give NULL or raise: ``log(0)`` is -inf, ``log(-1)``
and ``0.0/0`` are NaN, ``1.0/0`` is inf. NULL stays NULL. ``round`` and ``rint`` take
halves away from zero; ``%`` and its aliases keep the sign of the dividend; integer
division by zero gives 0.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, functions as F

from .core import INF, NAN, col, nan_if, real

pi = math.pi


def _unary(f, doc: str):
    def apply(x: Any) -> Column:
        return f(real(x))

    apply.__doc__ = doc
    return apply


sqrt = _unary(F.sqrt, "Square root; NaN below zero.")
cbrt = _unary(F.cbrt, "Cube root.")
exp = _unary(F.exp, "e to the power x.")
expm1 = _unary(F.expm1, "exp(x) - 1.")
sin = _unary(F.sin, "Sine.")
cos = _unary(F.cos, "Cosine.")
tan = _unary(F.tan, "Tangent.")
arcsin = asin = _unary(F.asin, "Inverse sine; NaN outside [-1, 1].")
arccos = acos = _unary(F.acos, "Inverse cosine; NaN outside [-1, 1].")
arctan = atan = _unary(F.atan, "Inverse tangent.")
sinh = _unary(F.sinh, "Hyperbolic sine.")
cosh = _unary(F.cosh, "Hyperbolic cosine.")
tanh = _unary(F.tanh, "Hyperbolic tangent.")
arcsinh = asinh = _unary(F.asinh, "Inverse hyperbolic sine.")
arccosh = acosh = _unary(F.acosh, "Inverse hyperbolic cosine; NaN below 1.")
arctanh = atanh = _unary(F.atanh, "Inverse hyperbolic tangent; NaN outside [-1, 1].")
deg2rad = radians = _unary(F.radians, "Degrees to radians.")
rad2deg = degrees = _unary(F.degrees, "Radians to degrees.")


def _log(f):
    def apply(x: Any) -> Column:
        x = real(x)
        return F.when(x > 0, f(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))

    return apply


log, log2, log10 = _log(F.ln), _log(F.log2), _log(F.log10)


def log1p(x: Any) -> Column:
    x = real(x)
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def exp2(x: Any) -> Column:
    return F.pow(F.lit(2.0), real(x))


def floor(x: Any) -> Column:
    x = real(x)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(F.floor(x).cast("double"))


def ceil(x: Any) -> Column:
    x = real(x)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(F.ceil(x).cast("double"))


def trunc(x: Any) -> Column:
    """Toward zero."""
    return F.when(real(x) < 0, ceil(x)).otherwise(floor(x))


fix = trunc


def rint(x: Any) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.round(real(x), 0)


def round(x: Any, decimals: int = 0) -> Column:  # noqa: A001
    return F.round(col(x), decimals)


def sign(x: Any) -> Column:
    return F.signum(real(x))


def abs(x: Any) -> Column:  # noqa: A001
    return F.abs(col(x))


absolute = fabs = abs


def square(x: Any) -> Column:
    return col(x) * col(x)


def positive(x: Any) -> Column:
    return F.positive(col(x))


def negative(x: Any) -> Column:
    return F.negative(col(x))


def _quotient(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) == ~signbit(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def divide(x1: Any, x2: Any) -> Column:
    """True division in doubles with IEEE results for zero divisors."""
    return _quotient(real(x1), real(x2))


true_divide = divide


def reciprocal(x: Any) -> Column:
    return divide(1.0, x)


def add(x1: Any, x2: Any) -> Column:
    return col(x1) + col(x2)


def subtract(x1: Any, x2: Any) -> Column:
    return col(x1) - col(x2)


def multiply(x1: Any, x2: Any) -> Column:
    return col(x1) * col(x2)


def power(x1: Any, x2: Any) -> Column:
    return F.pow(real(x1), real(x2))


pow = float_power = power  # noqa: A001


def floor_divide(x1: Any, x2: Any, integers: bool = False) -> Column:
    """floor(a / b); with ``integers`` a truncating division that gives 0 for a zero divisor."""
    if integers:
        b = col(x2)
        return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", col(x1), F.when(b != 0, b)))
    return floor(divide(x1, x2))


def remainder(x1: Any, x2: Any, integers: bool = False) -> Column:
    """The remainder with the dividend's sign; for a zero divisor NaN, or 0 with ``integers``."""
    a, b = col(x1), col(x2)
    if integers:
        return F.when(b == 0, F.lit(0)).otherwise(a % F.when(b != 0, b))
    a, b = real(x1), real(x2)
    return nan_if(b == 0, a % F.when(b != 0, b))


mod = fmod = remainder


def divmod(x1: Any, x2: Any) -> Column:  # noqa: A001
    return F.struct(floor_divide(x1, x2).alias("quotient"), remainder(x1, x2).alias("remainder"))


def arctan2(y: Any, x: Any) -> Column:
    return F.atan2(real(y), real(x))


def hypot(x1: Any, x2: Any) -> Column:
    return F.hypot(real(x1), real(x2))


def maximum(x1: Any, x2: Any) -> Column:
    """The larger; NaN if either is NaN."""
    a, b = real(x1), real(x2)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(a, b))


def minimum(x1: Any, x2: Any) -> Column:
    """The smaller; NaN if either is NaN."""
    a, b = real(x1), real(x2)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(nan_if(F.isnan(a) | F.isnan(b), F.least(a, b)))


def fmax(x1: Any, x2: Any) -> Column:
    """The larger, ignoring NaN."""
    a, b = real(x1), real(x2)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(maximum(a, b))


def fmin(x1: Any, x2: Any) -> Column:
    """The smaller, ignoring NaN."""
    a, b = real(x1), real(x2)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(minimum(a, b))


def signbit(x: Any) -> Column:
    """Whether the sign bit is set; also for -0.0."""
    x = real(x)
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def copysign(x1: Any, x2: Any) -> Column:
    size = F.abs(real(x1))
    return F.when(signbit(x2), -size).otherwise(size)


def logaddexp(x1: Any, x2: Any) -> Column:
    a, b = real(x1), real(x2)
    # equal values, infinities too, differ by nothing
    return F.greatest(a, b) + F.log1p(F.exp(-F.when(a == b, 0.0).otherwise(F.abs(a - b))))


def logaddexp2(x1: Any, x2: Any) -> Column:
    a, b = real(x1), real(x2)
    return F.greatest(a, b) + F.log1p(F.pow(F.lit(2.0), -F.when(a == b, 0.0).otherwise(F.abs(a - b)))) / math.log(2)


def heaviside(x: Any, h0: Any) -> Column:
    x = real(x)
    return nan_if(F.isnan(x), F.when(x < 0, 0.0).when(x == 0, real(h0)).otherwise(1.0))


def sinc(x: Any) -> Column:
    y = real(x) * pi
    return F.when(y == 0, F.lit(1.0)).otherwise(F.sin(y) / F.when(y != 0, y))


def clip(x: Any, a_min: Any = None, a_max: Any = None) -> Column:
    """Clamp; NaN stays NaN."""
    out = real(x)
    if a_min is not None:
        out = F.when(out < real(a_min), real(a_min)).otherwise(out)
    if a_max is not None:
        out = F.when((out > real(a_max)) & ~F.isnan(out), real(a_max)).otherwise(out)
    return out


def nan_to_num(x: Any, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Column:
    big = 1.7976931348623157e308
    x = real(x)
    return (
        F.when(F.isnan(x), F.lit(float(nan)))
        .when(x == INF, F.lit(big if posinf is None else float(posinf)))
        .when(x == -INF, F.lit(-big if neginf is None else float(neginf)))
        .otherwise(x)
    )


def ldexp(x: Any, i: Any) -> Column:
    return real(x) * F.pow(F.lit(2.0), real(i))


def modf(x: Any) -> Column:
    return F.struct((real(x) - trunc(x)).alias("fraction"), trunc(x).alias("whole"))


def frexp(x: Any) -> Column:
    """mantissa in [0.5, 1) with the sign of x, and exponent."""
    x = real(x)
    size = F.abs(x)
    first = F.floor(F.log2(F.when(size > 0, size))) + 1
    scaled = size / F.pow(F.lit(2.0), first)
    # the logarithm may be off by one beside a power of two
    exponent = F.when(size == 0, F.lit(0)).otherwise(first + F.when(scaled >= 1, 1).when(scaled < 0.5, -1).otherwise(0))
    return F.struct((x / F.pow(F.lit(2.0), exponent)).alias("mantissa"), exponent.cast("int").alias("exponent"))


def spacing(x: Any) -> Column:
    """The distance to the next double away from zero."""
    size = F.abs(real(x))
    exponent = F.greatest(frexp(size)["exponent"] - 53, F.lit(-1074))
    gap = F.when(size == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), exponent))
    return nan_if(F.isnan(size) | (size == INF), F.when(signbit(x), -gap).otherwise(gap))


def nextafter(x1: Any, x2: Any) -> Column:
    """The next double after x1 towards x2."""
    a, b = real(x1), real(x2)
    size = F.abs(a)
    mantissa, exponent = frexp(size)["mantissa"], frexp(size)["exponent"]
    gap = F.pow(F.lit(2.0), F.greatest(exponent - 53, F.lit(-1074)))
    # downwards from a power of two the gap is half as wide
    down = F.when((mantissa == 0.5) & (exponent > -1021), gap / 2).otherwise(gap)
    outward = (b > a) == (a > 0)
    moved = F.when(outward, size + gap).otherwise(size - down)
    small = F.when(b > 0, F.lit(5e-324)).otherwise(F.lit(-5e-324))
    return nan_if(F.isnan(a) | F.isnan(b), F.when(a == b, b).when(a == 0, small).otherwise(F.when(a < 0, -moved).otherwise(moved)))


def i0(x: Any) -> Column:
    """Modified Bessel function of order 0, by its power series (small x) or asymptotic series."""
    y = F.abs(real(x))
    quarter = y * y / 4
    factor = 1.0
    terms = []
    for k in range(1, 60):
        factor /= k * k
        terms.append(factor)
    series = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        series = series * quarter + F.lit(c)
    series = series * quarter + 1.0
    tail, coefficient = F.lit(0.0), 1.0
    inverse = 1 / F.when(y > 0, y)
    coefficients = [1.0]
    for k in range(1, 12):
        coefficient *= (2 * k - 1) ** 2 / (8 * k)
        coefficients.append(coefficient)
    for c in reversed(coefficients):
        tail = tail * inverse + F.lit(c)
    return F.when(y <= 30, series).otherwise(F.exp(y) / F.sqrt(2 * pi * y) * tail)


def gcd(x1: Any, x2: Any) -> Column:
    """Greatest common divisor by Euclid's steps (at most 92 for longs)."""
    start = F.struct(F.abs(col(x1).cast("bigint")).alias("a"), F.abs(col(x2).cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(x1: Any, x2: Any) -> Column:
    d = gcd(x1, x2)
    return F.when(d == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", F.abs(col(x1).cast("bigint")), F.when(d != 0, d)) * F.abs(col(x2).cast("bigint")))


euler_gamma = 0.5772156649015329
