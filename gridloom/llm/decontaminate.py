"""Benchmark decontamination with a distributed positional inverted index.

:func:`build_index` stores the postings of every training token, a row per shard
of documents: the shard's terms, and for each term the sorted places where it
stands. Places count words through the shard, with a gap between documents that no
phrase spans. Sharding is by document, so a term however frequent is spread over
all shards, and a search needs no shuffle.

:func:`phrase_hits` takes every window of consecutive test words, starts from the
posting list of its rarest term in the shard and intersects it with the
offset-adjusted lists of the others, rarest first. :func:`proximity_hits` asks only
that all terms stand within a distance of the rarest one.

The test items stream through the driver into broadcasts of at most ``BLOCK_BYTES``
each. A Python worker loads one after another and lets go of each, so what it holds
does not grow with their number; the executors keep them on disk where memory is short.

Defined cases: null and empty texts have no words and no windows; an item of fewer
than ``window`` words is one window; items that share an id count once; repeated
document rows give repeated results; other columns are ignored; without items
nothing is hit.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ALNUM_WORD, arrow_schema, lowered, release_memory, shared_dir

WINDOW = 13
#: Words of a shard, places between documents, and bytes of test text in a broadcast.
SHARD_WORDS, GAP, BLOCK_BYTES = 2_000_000, 64, 16 << 20
#: A document is contaminated if this share of its words is hit.
MIN_SHARE = 20

INDEX = "shard bigint, doc_ids binary, null_ids binary, doc_starts binary, doc_words binary, terms binary, term_counts binary, gaps binary"
VERDICT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
NEAR = "doc_id bigint, item_id string, place bigint"


class _Shard:
    """Documents being gathered into one index row."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.words: list[int] = []
        self.size = 0

    def add(self, doc: int | None, tokens: list[bytes]) -> None:
        known = self.vocabulary
        new = known.setdefault
        self.ids.append(np.fromiter((new(t, len(known)) for t in tokens), np.int32, len(tokens)))
        self.docs.append(doc)
        self.words.append(len(tokens))
        self.size += len(tokens)

    def row(self, shard: int) -> tuple:
        words = np.array(self.words, np.int64)
        starts = np.concatenate([[0], np.cumsum(words + GAP)[:-1]]).astype(np.int64)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        places = np.arange(len(ids), dtype=np.int32) + np.repeat(np.arange(len(words), dtype=np.int32) * GAP, words)
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(self.vocabulary)).astype(np.int32)
        sorted_places = places[order]
        gaps = np.diff(sorted_places, prepend=np.int32(0))
        firsts = np.cumsum(counts, dtype=np.int64) - counts
        gaps[firsts] = sorted_places[firsts]  # each term's list starts anew
        docs = np.array([-1 if d is None else d for d in self.docs], np.int64)
        nulls = np.array([d is None for d in self.docs], bool)
        return (shard, docs.tobytes(), nulls.tobytes(), starts.tobytes(), words.tobytes(), b"\n".join(self.vocabulary), counts.tobytes(), gaps.astype(np.int32).tobytes())


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored positional index of all documents."""
    schema = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, base = _Shard(), 0, TaskContext.get().partitionId() << 24

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(shard.row(base + n), schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, text in zip(*(c.to_pylist() for c in part.columns)):
                    shard.add(doc, ALNUM_WORD.findall(lowered(text)))
                    if shard.size >= shard_words:
                        yield done()
                        shard, n = _Shard(), n + 1
        if shard.docs:
            yield done()
        shard = None
        release_memory()

    spark = docs.sparkSession
    index = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, INDEX)
    # the delta-coded lists shrink well, so they are stored with zstd
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(index.schema).parquet(path)


class Postings:
    """A shard read back: posting lists by term."""

    def __init__(self, terms: bytes, counts: bytes, gaps: bytes, wanted: set[bytes]) -> None:
        self.lists: dict[bytes, np.ndarray] = {}
        ends = np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)
        steps = np.frombuffer(gaps, np.int32)
        for k, term in enumerate(terms.split(b"\n") if len(ends) else ()):
            if term in wanted:
                self.lists[term] = np.cumsum(steps[ends[k - 1] if k else 0 : ends[k]], dtype=np.int64)

    def count(self, term: bytes) -> int:
        found = self.lists.get(term)
        return 0 if found is None else len(found)

    def phrase(self, terms: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Places where the terms stand one after another."""
        order = np.argsort(counts, kind="stable")
        starts = self.lists[terms[order[0]]] - order[0]
        for k in order[1:]:
            starts = starts[_within(starts + k, self.lists[terms[k]])]
            if not len(starts):
                break
        return starts

    def near(self, terms: list[bytes], distance: int) -> np.ndarray:
        """Places of the rarest term with every other term at most ``distance`` words away."""
        order = sorted(set(terms), key=self.count)
        found = self.lists.get(order[0], np.zeros(0, np.int64))
        for t in order[1:]:
            if not len(found):
                break
            other = self.lists.get(t, np.zeros(0, np.int64))
            found = found[np.searchsorted(other, found - distance, "left") < np.searchsorted(other, found + distance, "right")]
        return found


def _within(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of (item_id, words) lists, each of bounded size."""
    out, block, size = [], [], 0
    context = items.sparkSession.sparkContext
    for item, text in items.selectExpr("cast(item_id as string)", "text").toLocalIterator():
        words = ALNUM_WORD.findall(lowered(text))
        if words:
            block.append((item if item is not None else "", words))
            size += len(text)
        if size >= block_bytes:
            out.append(context.broadcast(block))
            block, size = [], 0
    return out + ([context.broadcast(block)] if block else [])


def _loaded(blocks: list) -> Iterator[list]:
    """The value of each broadcast, forgotten by this process when the next one is asked for."""
    for block in blocks:
        yield block.value
        # PySpark keeps a value once it was read; without it, the next use reads the file again
        block.__dict__.pop("_value", None)


def _windows(postings: Postings, words: list[bytes], window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of each window of an item that occurs."""
    size = min(window, len(words))
    counts = np.array([postings.count(w) for w in words])
    least = np.lib.stride_tricks.sliding_window_view(counts, size).min(axis=1)
    for s in np.flatnonzero(least):
        places = postings.phrase(words[s : s + size], counts[s : s + size])
        if len(places):
            yield size, places


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every document: the words inside occurrences of the items' windows."""
    schema, blocks = arrow_schema(VERDICT), item_blocks(items, block_bytes)
    if window > GAP:
        raise ValueError(f"a window has at most {GAP} words")

    def search(row: dict) -> list[tuple]:
        starts, words = np.frombuffer(row["doc_starts"], np.int64), np.frombuffer(row["doc_words"], np.int64)
        docs, nulls = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["null_ids"], bool)
        edges = np.zeros(int(starts[-1] + words[-1]) + GAP + 1, np.int32)
        found: dict[int, set[str]] = {}
        for block in _loaded(blocks):
            wanted = {w for _, ws in block for w in ws}
            postings = Postings(row["terms"], row["term_counts"], row["gaps"], wanted)
            for item, ws in block:
                for size, places in _windows(postings, ws, window):
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + size, -1)
                    for d in np.unique(np.searchsorted(starts, places, "right") - 1).tolist():
                        found.setdefault(d, set()).add(item)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
        n_hit = hit[starts + words] - hit[starts]
        out = []
        for k, (doc, null, n, h) in enumerate(zip(docs.tolist(), nulls.tolist(), words.tolist(), n_hit.tolist())):
            names = sorted(found.get(k, ()))
            out.append((None if null else doc, n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0 and min_share * h >= n))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = search(batch.slice(at, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return index.mapInArrow(run, VERDICT)


def proximity_hits(index: DataFrame, items: DataFrame, distance: int) -> DataFrame:
    """(doc_id, item_id, place) where all words of an item stand near its rarest one."""
    schema, blocks = arrow_schema(NEAR), item_blocks(items)
    if distance >= GAP:
        raise ValueError(f"the distance must be under {GAP}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                starts, docs = np.frombuffer(row["doc_starts"], np.int64), np.frombuffer(row["doc_ids"], np.int64)
                nulls, out = np.frombuffer(row["null_ids"], bool), []
                for block in _loaded(blocks):
                    postings = Postings(row["terms"], row["term_counts"], row["gaps"], {w for _, ws in block for w in ws})
                    for item, words in block:
                        for place in postings.near(words, distance).tolist():
                            d = int(np.searchsorted(starts, place, "right")) - 1
                            out.append((None if nulls[d] else int(docs[d]), item, place - int(starts[d])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return index.mapInArrow(run, NEAR)
