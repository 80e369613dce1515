"""Array files read and written in byte ranges, as a Python data source.

A ``.npy`` file, a stored member of an ``.npz`` archive, or a file of raw numbers is a
start and a number of equal items. A read is cut into partitions of ``PART`` bytes,
each of which opens the file, seeks, and gives its elements ``CHUNK`` at a time; the
driver reads headers alone. Any file system that ``pyarrow.fs`` opens will do.

A write deals the elements by range of their place. The driver makes a hidden file of
the final size with the header; each task puts its elements at their offsets, so a
repeated task puts the same bytes at the same place; the commit checks the number of
elements and renames the file, so nobody sees half of one. The folder must be one that
driver and executors mount.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..arrays import Array, axis_name, unravel

#: Bytes of a partition, and elements of a batch.
PART, CHUNK = 64 << 20, 65536


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str) -> Any:
    system, at = file_system(path)
    return system.open_input_file(at)


def spark_kind(dtype: np.dtype) -> str:
    if dtype.kind == "c":
        return "struct<re:double,im:double>"
    return {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "U": "string"}[dtype.kind]


def arrow_values(x: np.ndarray) -> pa.Array:
    """NumPy values as the Spark kind of their dtype."""
    if x.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(x.real.astype(float)), pa.array(x.imag.astype(float))], ["re", "im"])
    if x.dtype.kind in "iu":
        if x.dtype.kind == "u" and x.dtype.itemsize == 8 and x.size and x.max() > np.iinfo(np.int64).max:
            raise OverflowError("an unsigned number has no place in a bigint")
        return pa.array(x.astype(np.int64))
    return pa.array(x.astype(float)) if x.dtype.kind == "f" else pa.array(x.tolist(), pa.string() if x.dtype.kind == "U" else pa.bool_())


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    start: int  # byte of the first element of the file
    name: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.dtype, self.files = np.dtype(options["dtype"]), json.loads(options["files"])
        self.step = max(1, int(options["part"]) // self.dtype.itemsize)

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(f["path"], k, min(self.step, f["count"] - k), f["start"], f["name"]) for f in self.files for k in range(0, f["count"], self.step)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark reads a source without partitions
            return
        size = self.dtype.itemsize
        with opened(partition.path) as f:
            f.seek(partition.start + partition.first * size)
            for k in range(0, partition.count, CHUNK):
                n = min(CHUNK, partition.count - k)
                data = f.read(n * size)
                if len(data) < n * size:
                    raise EOFError(f"{partition.path} ends before its elements do")
                at = np.arange(partition.first + k, partition.first + k + n)
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n, pa.string()), pa.array(at), arrow_values(np.frombuffer(data, self.dtype))], ["path", "flat", "v"])


@dataclass
class _Written(WriterCommitMessage):
    count: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.dtype, self.start, self.count = np.dtype(options["dtype"]), int(options["start"]), int(options["count"])
        self.path, self.hidden = options["target"], options["hidden"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        total = 0
        with open(self.hidden, "r+b") as f:
            for batch in iterator:
                at, v = batch.column("flat").to_numpy(), batch.column("v")
                if v.null_count:
                    raise ValueError("an array file has no place for nulls")
                if self.dtype.kind == "c":
                    x = (v.field("re").to_numpy() + 1j * v.field("im").to_numpy()).astype(self.dtype)
                else:
                    x = np.asarray(v.to_numpy(zero_copy_only=False)).astype(self.dtype)
                if len(at) and (at.min() < 0 or at.max() >= self.count):
                    raise ValueError("an element lies outside of the shape")
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(run):
                        f.seek(self.start + int(at[run[0]]) * self.dtype.itemsize)
                        f.write(x[run].tobytes())
                total += len(at)
            f.flush()
            os.fsync(f.fileno())
        return _Written(total)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        total = sum(m.count for m in messages if m)
        if total > self.count:
            os.remove(self.hidden)
            raise ValueError(f"{total} elements for {self.count} places")
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_array_files"

    def schema(self) -> str:
        return f"path string, flat bigint, v {spark_kind(np.dtype(self.options['dtype']))}"

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def read_ranges(spark: SparkSession, dtype: np.dtype, files: Sequence[dict], part: int = PART) -> DataFrame:
    """path, flat and v for each element of ``files`` (path, name, start and count each)."""
    spark.dataSource.register(ArrayFiles)
    return spark.read.format(ArrayFiles.name()).option("dtype", dtype.str).option("part", str(part)).option("files", json.dumps(list(files))).load()


def header(f: Any) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """(shape, whether columns come first, kind, length of the header) of an array file at its start."""
    stream = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, columns_first, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError("arrays of objects aren't read")
    return shape, columns_first, dtype, stream.tell()


def _array(spark: SparkSession, path: str, begin: int, part: int) -> Array:
    with opened(path) as f:
        f.seek(begin)
        shape, columns_first, dtype, length = header(f)
    count = int(np.prod(shape, dtype=np.int64))
    df = read_ranges(spark, dtype, [{"path": path, "name": path, "start": begin + length, "count": count}], part)
    at = unravel(F.col("flat"), shape[::-1])[::-1] if columns_first else unravel(F.col("flat"), shape)
    return Array(df.select(*(c.alias(axis_name(k)) for k, c in enumerate(at)), "v"), tuple(shape))


def load_npy(spark: SparkSession, path: str, part: int = PART) -> Array:
    """A ``.npy`` file of any size, rows or columns first, either byte order."""
    return _array(spark, path, 0, part)


def stored_members(path: str) -> dict[str, int | None]:
    """The members of an ``.npz`` archive: the byte where the array file starts, or None where it is compressed."""
    found: dict[str, int | None] = {}
    with opened(path) as f, zipfile.ZipFile(f) as archive:
        for info in archive.infolist():
            f.seek(info.header_offset + 26)
            name, extra = struct.unpack("<HH", f.read(4))
            found[info.filename.removesuffix(".npy")] = info.header_offset + 30 + name + extra if info.compress_type == zipfile.ZIP_STORED else None
    return found


def load_npz(spark: SparkSession, path: str, part: int = PART) -> dict[str, Array]:
    """The arrays of an archive; a compressed member can't be cut and is read by one task, some elements at a time."""
    return {name: _array(spark, path, begin, part) if begin is not None else _inflated(spark, path, name) for name, begin in stored_members(path).items()}


def _inflated(spark: SparkSession, path: str, name: str) -> Array:
    with opened(path) as f, zipfile.ZipFile(f) as archive, archive.open(f"{name}.npy") as member:
        shape, columns_first, dtype, length = header(member)
    count = int(np.prod(shape, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                with opened(path) as f, zipfile.ZipFile(f) as archive, archive.open(f"{name}.npy") as member:
                    member.read(length)
                    for k in range(0, count, CHUNK):
                        x = np.frombuffer(member.read(min(CHUNK, count - k) * dtype.itemsize), dtype)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(x))), arrow_values(x)], ["flat", "v"])

    df = spark.range(1).mapInArrow(run, f"flat bigint, v {spark_kind(dtype)}")
    at = unravel(F.col("flat"), shape[::-1])[::-1] if columns_first else unravel(F.col("flat"), shape)
    return Array(df.select(*(c.alias(axis_name(k)) for k, c in enumerate(at)), "v"), tuple(shape))


def fromfile(spark: SparkSession, paths: Sequence[str], dtype: str, count: int = -1, offset: int = 0, part: int = PART) -> DataFrame:
    """path, i0 and v for each number of raw files; what is left of a file after whole items is ignored."""
    kind, files = np.dtype(dtype), []
    for path in paths:
        system, at = file_system(path)
        whole = max(0, system.get_file_info(at).size - offset) // kind.itemsize
        files.append({"path": path, "name": path, "start": offset, "count": whole if count < 0 else min(count, whole)})
    return read_ranges(spark, kind, files, part).select("path", F.col("flat").alias("i0"), "v")


def _write(df: DataFrame, flat: Column, count: int, dtype: np.dtype, path: str, head: bytes) -> None:
    system, target = file_system(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError("array files are written to a folder that driver and executors mount")
    hidden = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}-{uuid.uuid4().hex}")
    with open(hidden, "wb") as f:
        f.write(head)
        f.truncate(len(head) + count * dtype.itemsize)
    spark = df.sparkSession
    spark.dataSource.register(ArrayFiles)
    dealt = df.select(F.lit("").alias("path"), flat.alias("flat"), "v").repartitionByRange("flat").sortWithinPartitions("flat")
    out = dealt.write.format(ArrayFiles.name()).mode("append").option("dtype", dtype.str).option("start", str(len(head))).option("count", str(count))
    out.option("target", target).option("hidden", hidden).save()


def _dtype_of(a: Array) -> np.dtype:
    kind = a.dtype
    if kind.startswith("struct"):
        return np.dtype("<c16")
    kinds = {"boolean": "?", "tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}
    if kind not in kinds:
        raise ValueError(f"an array file has no {kind}")
    return np.dtype(kinds[kind])


def save_npy(a: Array, path: str) -> None:
    """One ``.npy`` file, rows first; an element that lacks is zero."""
    dtype, stream = _dtype_of(a), io.BytesIO()
    np.lib.format.write_array_header_1_0(stream, {"descr": dtype.str, "fortran_order": False, "shape": tuple(a.shape)})
    _write(a.df, a.flat(), a.size, dtype, path, stream.getvalue())


def tofile(a: Array, path: str, dtype: str | None = None) -> None:
    """One file of raw numbers, rows first."""
    _write(a.df, a.flat(), a.size, np.dtype(dtype) if dtype else _dtype_of(a), path, b"")
