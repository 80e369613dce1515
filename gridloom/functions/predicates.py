"""Comparisons, logic and classification. NaN compares unequal to everything."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .core import INF, col, real


def isnan(x: Any) -> Column:
    return F.isnan(real(x))


def isinf(x: Any) -> Column:
    return F.abs(real(x)) == INF


def isfinite(x: Any) -> Column:
    return ~isnan(x) & ~isinf(x)


def isposinf(x: Any) -> Column:
    return real(x) == INF


def isneginf(x: Any) -> Column:
    return real(x) == -INF


def isnat(x: Any) -> Column:
    """A missing date or time is NULL."""
    return col(x).isNull()


def _ordered(a: Any, b: Any) -> Column:
    return ~F.isnan(real(a)) & ~F.isnan(real(b))


def equal(x1: Any, x2: Any) -> Column:
    return (col(x1) == col(x2)) & _ordered(x1, x2)


def not_equal(x1: Any, x2: Any) -> Column:
    return ~equal(x1, x2)


def less(x1: Any, x2: Any) -> Column:
    return (col(x1) < col(x2)) & _ordered(x1, x2)


def less_equal(x1: Any, x2: Any) -> Column:
    return (col(x1) <= col(x2)) & _ordered(x1, x2)


def greater(x1: Any, x2: Any) -> Column:
    return (col(x1) > col(x2)) & _ordered(x1, x2)


def greater_equal(x1: Any, x2: Any) -> Column:
    return (col(x1) >= col(x2)) & _ordered(x1, x2)


def truthy(x: Any) -> Column:
    """Not zero; NaN is true."""
    return real(x) != 0


def logical_and(x1: Any, x2: Any) -> Column:
    return truthy(x1) & truthy(x2)


def logical_or(x1: Any, x2: Any) -> Column:
    return truthy(x1) | truthy(x2)


def logical_xor(x1: Any, x2: Any) -> Column:
    return truthy(x1) != truthy(x2)


def logical_not(x: Any) -> Column:
    return ~truthy(x)


def isclose(x1: Any, x2: Any, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = real(x1), real(x2)
    near = F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b) & F.lit(equal_nan)).when((F.abs(a) == INF) | (F.abs(b) == INF), a == b)
    return near.otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))


def allclose(x1: Any, x2: Any, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    """An aggregate: whether all pairs are close."""
    return F.coalesce(F.bool_and(isclose(x1, x2, rtol, atol, equal_nan)), F.lit(True))


def _complex(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["re", "im"]


def iscomplexobj(df: DataFrame, name: str) -> bool:
    return _complex(df, name)


def isrealobj(df: DataFrame, name: str) -> bool:
    return not _complex(df, name)


def isscalar(x: Any) -> bool:
    return isinstance(x, (int, float, complex, bool, str, bytes))
