"""Text and binary sources and sinks for arrays.

The native form is Parquet. Array files are read and written in byte ranges
(:mod:`ranges`).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array
from . import ranges


def _lines(spark: SparkSession, path: str, columns: Sequence[str], delimiter: str, comments: str, skip: int, skip_footer: int, max_rows: int | None) -> DataFrame:
    """The lines of one text file as string columns, in order of lines; skipping and limits go by the number of the line."""
    from .. import arrays

    text = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    numbered = arrays.number_rows(text, ["at"], "line").filter(F.col("line") >= skip)
    if skip_footer:
        numbered = numbered.filter(F.col("line") < text.count() - skip_footer)
    body = F.split("value", re.escape(comments), 2)[0] if comments else F.col("value")
    numbered = numbered.withColumn("value", F.btrim(body, F.lit(" \t\r"))).filter("value <> ''")
    if max_rows is not None:
        numbered = arrays.number_rows(numbered.select("line", "value"), ["line"], "row").filter(F.col("row") < max_rows)
    parts = F.split("value", r"\s+" if delimiter == " " else re.escape(delimiter), -1)
    return numbered.select(*(F.btrim(F.get(parts, F.lit(k)), F.lit(" \t\r")).alias(c) for k, c in enumerate(columns)))


def loadtxt(
    spark: SparkSession, path: str, columns: Sequence[str], dtype: str = "double", delimiter: str = " ", comments: str = "#", skip_header: int = 0, usecols: Sequence[int] | None = None, max_rows: int | None = None
) -> DataFrame:
    """A delimited text as columns; a field that does not fit fails the read.

    ``skip_header`` and ``max_rows`` are of one file: its lines are numbered then.
    """
    if skip_header or max_rows is not None:
        rows = _lines(spark, path, columns, delimiter, comments, skip_header, 0, max_rows)
        df = rows.select(*(F.col(c).cast(dtype).alias(c) for c in columns))
    else:
        ddl = ", ".join(f"`{c}` {dtype}" for c in columns)
        reader = spark.read.schema(ddl).option("sep", delimiter).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        df = reader.option("comment", comments).csv(path) if comments else reader.csv(path)
    return df.select(*(columns[k] for k in usecols)) if usecols else df


def genfromtxt(
    spark: SparkSession, path: str, columns: Sequence[str], delimiter: str = ",", comments: str = "#", missing: Sequence[str] = ("",), filling: float = float("nan"), header: bool = False, skip_header: int = 0, skip_footer: int = 0, max_rows: int | None = None
) -> DataFrame:
    """As :func:`loadtxt`; missing or unreadable fields become ``filling``."""
    if skip_header or skip_footer or max_rows is not None:
        df = _lines(spark, path, columns, delimiter, comments, skip_header + header, skip_footer, max_rows)
    else:
        ddl = ", ".join(f"`{c}` string" for c in columns)
        df = spark.read.schema(ddl).option("sep", delimiter).option("comment", comments).option("header", header).csv(path)
    parsed = lambda c: F.coalesce(F.when(~F.trim(c).isin(list(missing)), F.expr(f"try_cast(trim(`{c}`) as double)")), F.lit(filling))
    return df.select(*(parsed(c).alias(c) for c in columns))


def savetxt(df: DataFrame, path: str, fmt: str = "%s", delimiter: str = " ", header: bool = False) -> None:
    """A folder of text parts, a line for each row."""
    out = df if fmt == "%s" else df.select(*(F.format_string(fmt, F.col(c)).alias(c) for c in df.columns))
    out.write.option("sep", delimiter).option("header", header).option("quote", "").csv(path)


def save(a: Array, path: str) -> None:
    """The native form: Parquet with the shape beside each element's index."""
    a.df.withColumn("__shape", F.array(*(F.lit(n).cast("bigint") for n in a.shape)) if a.shape else F.array().cast("array<bigint>")).write.parquet(path)


def load(spark: SparkSession, path: str) -> Array:
    """An array saved by :func:`save`, or a ``.npy`` file."""
    if path.endswith(".npy"):
        return load_npy(spark, path)
    df = spark.read.parquet(path)
    first = df.select("__shape").first()
    return Array(df.drop("__shape"), tuple(first[0]) if first else (0,))


def savez(path: str, **arrays: Array) -> None:
    """One Parquet table for each named array in a folder."""
    for name, a in arrays.items():
        save(a, f"{path}/{name}")


savez_compressed = savez


def loadz(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, Array]:
    return {n: load(spark, f"{path}/{n}") for n in names}


load_npy, save_npy, load_npz = ranges.load_npy, ranges.save_npy, ranges.load_npz


def save_npz(path: str, **arrays: Array) -> None:
    """One ``.npz`` file on the driver's side, for arrays that fit there; :func:`savez` is the form for others."""
    np.savez(path, **{name: a.collect() for name, a in arrays.items()})


def frombuffer(df: DataFrame, name: str, dtype: str = "<f8", count: int = -1, offset: int = 0) -> DataFrame:
    """A binary column as an array column of numbers."""
    kind = "bigint" if np.dtype(dtype).kind in "iu" else "double"
    keep = [c for c in df.columns if c != name]
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != name), f"`{name}` array<{kind}>"])

    def run(batches):
        for batch in batches:
            lists = [None if b is None else np.frombuffer(b, dtype, count, offset).tolist() for b in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lists, pa.list_(pa.int64() if kind == "bigint" else pa.float64()))], [*keep, name])

    return df.select(*keep, name).mapInArrow(run, ddl)


def fromfile(spark: SparkSession, path: str, dtype: str = "<f8", count: int = -1, offset: int = 0, sep: str = "") -> DataFrame:
    """Raw binary files, or with ``sep`` texts of numbers: path, i0 and v for each number."""
    if sep:
        texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\s+" if not sep.strip() else re.escape(sep.strip()), -1).alias("v"))
        rows = texts.select("path", F.posexplode(F.array_remove(F.transform("v", F.trim), "")).alias("i0", "v"))
        return rows.select("path", "i0", F.col("v").cast("double").alias("v"))
    found = spark.read.format("binaryFile").load(path).select("path")  # names alone, the contents are not read
    return ranges.fromfile(spark, [r["path"] for r in found.collect()], dtype, count, offset)


def tofile(a: Array, path: str, sep: str = " ") -> None:
    """The values in row-major order as text parts that keep the order; without ``sep``, one file of raw numbers."""
    if not sep:
        return ranges.tofile(a, path)
    ordered = a.df.withColumn("__flat", a.flat()).repartitionByRange("__flat").sortWithinPartitions("__flat")
    ordered.select(F.col("v").cast("string").alias("value")).write.text(path)


def element_count(shape: Sequence[int]) -> int:
    return math.prod(shape)
