"""Shared helpers of the Column functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F

INF = float("inf")
NAN = float("nan")


def col(x: Any) -> Column:
    """A Column for a Column, a column name, or a Python scalar."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def real(x: Any) -> Column:
    """The value as a double."""
    return col(x).cast("double")


def nan_if(test: Column, value: Column) -> Column:
    return F.when(test, F.lit(NAN)).otherwise(value)


def drop_nan(x: Any) -> Column:
    """NaN as null, so that aggregates skip it."""
    x = real(x)
    return F.when(~F.isnan(x), x)


def is_complex(c: Any) -> bool:
    """Whether a value of this package is a complex struct made by :func:`complex_`."""
    return isinstance(c, tuple)
