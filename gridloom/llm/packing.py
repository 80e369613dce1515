"""Best-fit packing with large-item matching.

Documents are tokenized, closed with an end id and, where longer than a sequence,
cut so that only the first piece is short. Whole pieces fill a sequence alone.
Among the rest, pieces over a third of the capacity are large: a greedy matching
puts at most two of them into a bin, the largest with the largest partner that
fits. Smaller pieces then go, longest first, into the bin with the least room that
holds them.

Only slim rows (ids, lengths, checksums) are shuffled. They are stored, then dealt by
a hash of their key and their place in that table (so equal rows spread) into parts
packed independently; a part's result depends on its rows alone, so a lost task gives
the same sequences again. Each part leaves at most a few bins part-filled, which is
why parts hold many pieces.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
repeatedly; other columns are ignored; no documents give no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import bpe
from .common import arrow_schema, map_chunks, stored

CAPACITY = 2048
#: Tokens, and pieces, of a packing part at most, about (it holds tens of thousands of sequences).
PART_TOKENS, PART_PIECES = 64 << 20, 1 << 20

PIECES = 64 << 20, 1 << 20
#: Distinct words whose ids a Python worker keeps (some 30 bytes each), and words encoded in one call.
CACHE_WORDS, JOINED = 1_000_000, 512

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every document with the checksum of their ids."""
    end = np.array([end_id], np.uint32)

    def cut(columns: list[list]) -> list[list]:
        rows = []
        for doc, ids in zip(columns[0], bpe(tokenizer_path).encode([t or "" for t in columns[1]])):
            data = np.concatenate([ids, end]).astype("<u4").tobytes()
            n, at, piece = len(data) // 4, 0, 0
            while at < n:
                size = (n - at) % capacity or capacity
                rows.append((doc, piece, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                at, piece = at + size, piece + 1
        return [list(x) for x in zip(*rows)]

    return map_chunks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), PIECES, cut, rows=4096)


def pack_lengths(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every item. Bins are found by room: a bit mask of the rooms in use gives the least that fits."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def push(b: int) -> None:
        nonlocal mask
        room = capacity - used[b]
        if room > 0:
            stacks[room].append(b)
            mask |= 1 << room

    def place(k: int, b: int) -> None:
        bins[k], offsets[k] = b, used[b]
        used[b] += lengths[k]

    large = [k for k in order if 3 * lengths[k] > capacity]
    # greedy matching: each of the largest takes the largest partner that still fits
    partners: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    free = 0
    for k in large:
        partners[lengths[k]].append(k)
        free |= 1 << lengths[k]
    taken = set()
    for k in large:
        if k in taken:
            continue
        taken.add(k)
        mine = partners[lengths[k]]
        mine.popleft()  # this is k: pieces come in this order, and partners leave at the other end
        if not mine:
            free &= ~(1 << lengths[k])
        used.append(0)
        b = len(used) - 1
        place(k, b)
        fits = free & ((1 << (capacity - lengths[k] + 1)) - 1)
        if fits:
            size = fits.bit_length() - 1
            other = partners[size].pop()
            taken.add(other)
            if not partners[size]:
                free &= ~(1 << size)
            place(other, b)
        push(b)
    for k in order[len(large) :]:
        fits = mask >> lengths[k]
        if fits:
            room = lengths[k] + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            used.append(0)
            b = len(used) - 1
        place(k, b)
        push(b)
    return bins, offsets


def pack_pieces(pieces: DataFrame, parts: int, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset for each piece; ``parts`` parts are packed on their own.

    ``pieces`` is a stored table: a row is dealt by its place too, so that equal rows spread over the parts.
    """
    schema, row = arrow_schema(PACKED), "row_number"
    placed = pieces.withColumn(row, F.monotonically_increasing_id())
    keys = ("doc_id", "piece", "ids_crc32", row)
    dealt = placed.repartition(parts, F.xxhash64(*keys)).sortWithinPartitions("length", *keys).drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        bins, offsets = pack_lengths(table.column("length").to_pylist(), capacity)
        part = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array([part + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.cast(schema).to_batches(max_chunksize=65536)

    return dealt.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, part_tokens: int = PART_TOKENS, part_pieces: int = PART_PIECES) -> DataFrame:
    """Tokenize, cut and pack all documents."""
    pieces = stored(tokenize_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    rows, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return pack_pieces(pieces, 1 + max(tokens // part_tokens, rows // part_pieces), capacity)
