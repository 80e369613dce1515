"""Bitwise operations on integer columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .core import col


def bitwise_and(x1: Any, x2: Any) -> Column:
    return col(x1).bitwiseAND(col(x2))


def bitwise_or(x1: Any, x2: Any) -> Column:
    return col(x1).bitwiseOR(col(x2))


def bitwise_xor(x1: Any, x2: Any) -> Column:
    return col(x1).bitwiseXOR(col(x2))


def bitwise_not(x: Any) -> Column:
    return F.bitwise_not(col(x))


invert = bitwise_not


def left_shift(x1: Any, x2: Any) -> Column:
    """Shift count modulo the width, as the JVM does."""
    return F.call_function("shiftleft", col(x1), col(x2).cast("int"))


def right_shift(x1: Any, x2: Any) -> Column:
    return F.call_function("shiftright", col(x1), col(x2).cast("int"))


def packbits(df: DataFrame, index: str, value: str, bitorder: str = "big") -> DataFrame:
    """Eight truth values to a byte: columns ``index`` (of the byte) and ``value``."""
    place = F.pmod(F.col(index), F.lit(8)).cast("int")
    shift = 7 - place if bitorder == "big" else place
    bit = F.when(F.col(value).cast("double") != 0, F.call_function("shiftleft", F.lit(1), shift)).otherwise(0)
    return df.groupBy(F.floor(F.col(index) / 8).cast("bigint").alias(index)).agg(F.sum(bit).cast("int").alias(value))


def unpackbits(df: DataFrame, index: str, value: str, bitorder: str = "big") -> DataFrame:
    """A byte to eight bits: columns ``index`` (of the bit) and ``value``."""
    out = df.select((F.col(index) * 8).alias("__base"), F.col(value).cast("int").alias("__byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("__k"))
    shift = 7 - F.col("__k") if bitorder == "big" else F.col("__k")
    return out.select((F.col("__base") + F.col("__k")).cast("bigint").alias(index), F.call_function("shiftright", F.col("__byte"), shift).bitwiseAND(F.lit(1)).alias(value))
