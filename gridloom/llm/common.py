"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.storage import shared_dir, stored  # noqa: F401

#: Rows, and bytes of text, that a Python worker turns into Python objects at a time (a row at least).
CHUNK_ROWS, CHUNK_BYTES = 256, 1_000_000

#: The two word classes of the contracts, over lower-cased UTF-8 bytes: every
#: byte from 0x80 up belongs to a non-ASCII character, so byte classes are exact.
ALNUM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: ASCII white space as bytes.split() and the contracts understand it.
WHITE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def chunks_of(batch: pa.RecordBatch, rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and so many bytes of strings where they have more than a row."""
    lengths = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def map_chunks(df: DataFrame, ddl: str, fn: Callable[[list[list]], list], rows: int = CHUNK_ROWS) -> DataFrame:
    """``mapInArrow`` with ``fn`` called on a few rows at a time.

    ``fn`` gets a Python list per column of ``df`` and returns a list (or Arrow
    array) per column of the schema ``ddl``.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of(batch, rows):
                out = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema
                )
        release_memory()

    return df.mapInArrow(run, ddl)


def release_memory() -> None:
    """Give freed memory back to the system: a worker waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_worker(name: str, make: Callable):
    """What ``make()`` gave in this Python process under ``name``: kept from task to task."""
    held = sys.modules.setdefault("__gridloom_worker__", types.ModuleType("__gridloom_worker__")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


#: Ids that may be broadcast at once: 8 bytes each, some 100 MB as a hash table.
MAX_IDS = 2_000_000


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def content_key(*columns: str) -> Column:
    """A 64-bit hash of the columns' values, nulls told apart: equal for rows of equal values only, up to chance."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def without(docs: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``ids`` (one column, of few ids as a rule).

    The ids are broadcast only if their number is under ``MAX_IDS``; beyond it both
    sides are shuffled. Rows with a null key stay.
    """
    name = free_name(docs, "gone")
    gone = stored(ids.select(F.col(ids.columns[0]).cast("bigint").alias(name)).distinct(), "gone")
    if gone.limit(MAX_IDS + 1).count() <= MAX_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key.cast("bigint") == F.col(name), "left_anti")


_M1, _M2, ROLL, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def spans_of(array: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a dictionary without nulls; much faster than ``to_pylist``."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1].tolist()
    held = data.to_pybytes() if data is not None else b""
    return [held[a:b] for a, b in zip(at, at[1:])]


def span_hashes(data: bytes, edges: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of ``data`` between each edge and the next; equal spans are hashed once."""
    spans = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    coded = spans.dictionary_encode()
    found = spans_of(coded.dictionary)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))[coded.indices.to_numpy()]
