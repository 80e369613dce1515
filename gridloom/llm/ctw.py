"""LM scoring by context-tree weighting over binary-decomposed bytes.

A text is the sequence of its words (lower-cased, split at ASCII white space) and one
end. A word is coded as its bytes and a closing space, the end as a line feed. The
context of a byte is the ``DEPTH`` bytes before it in the running text, across words;
before its beginning stand line feeds. Each byte is eight binary choices; at every
choice the Krichevsky-Trofimov estimates of all depths from 0 to ``DEPTH`` are mixed
with the weights of the context tree, so the code is a proper distribution over
sequences. A context that was never seen adds nothing to the mixture. ``bits_per_byte`` is the
code length of a text by the bytes so coded.

The tree is fitted on every training text, whatever their number:

1. Texts become stored blocks: numbered words and the sequence of their numbers.
2. Word counts are summed over blocks by hash, for the base score.
3. A block's grams (context and byte) are counted where the block is, and packed by
   part: their two nearest context bytes. Packed rows are merged by part and lane (a
   lane is a bounded number of blocks), then by part, so that all deeper nodes of a
   subtree meet; depths 0 and 1, a fixed number of nodes, are joined on the driver.
4. The packed grams of each part and lane stream past the part's probabilities and
   go back to their blocks, where the bytes of each text are summed.

What is shuffled are distinct grams of blocks, some bytes for each, not occurrences.
Words are keyed by a 64-bit hash and 15 bits of another.

Defined cases: null and empty texts are the end alone; a null doc_id counts as the
empty text when folds are drawn; repeated rows each count; other columns are ignored;
without training texts all counts are zero and estimates even.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_schema, lowered, release_memory, stored

DEPTH, FOLDS, HELD_OUT = 5, 5, 1
#: Words in a block of documents, and blocks in a lane.
BLOCK_WORDS, LANE_BLOCKS = 3_000_000, 64
#: Grams of whole subtrees that a task works on at a time, and of a row of the model.
SUBTREE_GRAMS, MODEL_GRAMS = 200_000, 8192
#: Bytes of text that are turned into grams at a time.
CHUNK = 1 << 19
END = b"\n"

BLOCKS = "block bigint, doc_ids binary, null_ids binary, held_out binary, doc_words binary, doc_bytes binary, tokens binary, words binary, hashes binary, checks binary, counts binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def packed_tokens(tokens: np.ndarray) -> bytes:
    """Word numbers byte plane by byte plane, compressed."""
    return pa.compress(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def tokens_of(row: dict) -> np.ndarray:
    n = int(np.frombuffer(row["doc_words"], np.int64).sum())
    planes = np.frombuffer(pa.decompress(row["tokens"], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


class _Block:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.docs, self.sizes, self.bytes, self.held, self.tokens, self.n = [], [], [], [], [], 0

    def add(self, doc: int | None, words: list[bytes]) -> None:
        known = self.known
        number = known.setdefault
        self.tokens.append(np.fromiter((number(w, len(known)) for w in words), np.int32, len(words)))
        self.docs.append(doc)
        self.sizes.append(len(words))
        self.bytes.append(sum(map(len, words)) + len(words) - 1)  # a space after each word; the end is one byte
        self.held.append(fold(doc) == HELD_OUT)
        self.n += len(words)

    def row(self, block: int) -> tuple:
        tokens, sizes, held = np.concatenate(self.tokens), np.array(self.sizes, np.int64), np.array(self.held, bool)
        counts = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(self.known)).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.known), np.uint64, len(self.known))
        checks = np.fromiter((zlib.crc32(w) & 0x7FFF for w in self.known), np.int16, len(self.known))
        docs = np.array([0 if d is None else d for d in self.docs], np.int64)
        nulls = np.array([d is None for d in self.docs], bool)
        return (block, docs.tobytes(), nulls.tobytes(), held.tobytes(), sizes.tobytes(), np.array(self.bytes, np.int64).tobytes(), packed_tokens(tokens), b" ".join(self.known), hashes.tobytes(), checks.tobytes(), counts.tobytes())


def blocks_of(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Stored blocks of numbered words."""
    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, block = TaskContext.get().partitionId() << 24, 0, _Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    words = lowered(text).split()
                    words.append(END)
                    block.add(doc, words)
                    if block.n >= block_words:
                        yield _batch([block.row(base + n)], schema)
                        n, block = n + 1, _Block()
        if block.docs:
            yield _batch([block.row(base + n)], schema)
        del block
        release_memory()

    return stored(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, BLOCKS), "blocks")


def _explode(frame: DataFrame, ddl: str, fn) -> DataFrame:
    """``fn(row)`` gives the columns of the rows that a packed row stands for."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                columns = fn(batch.slice(at, 1).to_pylist()[0])
                whole = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)
                for k in range(0, whole.num_rows, 65536):
                    yield whole.slice(k, 65536)
        release_memory()

    return frame.mapInArrow(run, ddl)


def _word_rows(row: dict) -> list:
    hashes = np.frombuffer(row["hashes"], np.int64)
    return [np.full(len(hashes), row["block"]), np.arange(len(hashes), dtype=np.int32), hashes, np.frombuffer(row["checks"], np.int16), np.frombuffer(row["counts"], np.int64)]


def coded_bytes(row: dict, depth: int) -> bytes:
    """The running text of a block, with ``depth`` line feeds before each text."""
    coded = [b"\n" * depth if w == END else w + b" " for w in row["words"].split(b" ")]
    tokens = tokens_of(row)
    parts = [b"".join(map(coded.__getitem__, tokens[k : k + CHUNK].tolist())) for k in range(0, len(tokens), CHUNK)]
    return b"".join([b"\n" * depth, *parts])


def gram_chunks(data: bytes, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, number of its text) of every coded byte, ``CHUNK`` bytes at a time.

    ``data`` holds texts of so many coded bytes, ``depth`` line feeds before the first,
    and ``depth`` - 1 more after the end of each. A gram holds the context, the nearest
    byte highest, and the coded byte lowest.
    """
    raw, ends = np.frombuffer(data, np.uint8), np.cumsum(sizes)
    starts, total = ends - sizes, int(ends[-1])
    for a in range(0, total, CHUNK):
        b = min(a + CHUNK, total)
        first, last = (int(x) for x in np.searchsorted(ends, [a, b - 1], "right"))
        texts = np.arange(first, last + 1)
        owner = np.repeat(texts, np.minimum(ends[texts], b) - np.maximum(starts[texts], a))
        place = np.arange(a, b) + depth + owner * (depth - 1)
        low = int(place[0])
        near = raw[low - depth : int(place[-1]) + 1].astype(np.uint64)
        n = len(near) - depth
        code = np.zeros(n, np.uint64)
        for d in range(1, depth + 1):
            code = code << np.uint64(8) | near[depth - d : depth - d + n]
        yield (code << np.uint64(8) | near[depth:]).view(np.int64)[place - low], owner


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All of :func:`gram_chunks`, for texts that are coded already."""
    data = b"\n" * depth + b"".join(t + b"\n" * (depth - 1) for t in texts)
    parts = list(gram_chunks(data, np.array([len(t) for t in texts], np.int64), depth))
    return np.concatenate([g for g, _ in parts]), np.concatenate([o for _, o in parts])


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of several (grams, weights), with the sums of their weights."""
    grams = np.concatenate([g for g, _ in parts])
    order = np.argsort(grams, kind="stable")
    grams, weights = grams[order], np.concatenate([w for _, w in parts])[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.add.reduceat(weights, starts)


def training_grams(row: dict, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block and how often training texts have them: never, for some."""
    held, sizes = np.frombuffer(row["held_out"], bool), np.frombuffer(row["doc_bytes"], np.int64)
    parts, waiting, floor = [], 0, 0
    for grams, owner in gram_chunks(coded_bytes(row, depth), sizes, depth):
        keys = grams << 1 | held[owner]
        keys.sort()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] >> 1 != keys[:-1] >> 1]))
        parts.append((keys[starts] >> 1, np.add.reduceat(1 - (keys & 1), starts)))
        waiting += len(starts)
        if waiting > CHUNK + 2 * floor:
            parts = [summed(parts)]
            waiting = floor = len(parts[0][0])
    return summed(parts)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers by their differences, compressed."""
    return pa.compress(np.diff(numbers, prepend=0).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.int64))


def _part_cuts(grams: np.ndarray, depth: int) -> list[int]:
    """Where each part of sorted grams begins, and the end."""
    part = grams >> (8 * (depth - 1))
    return [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series after a shift."""
    y = x + 6
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - 2 * math.lgamma(0.5) - _ln_gamma(zeros + ones + 1)


class _Level:
    """The nodes of one depth for one of the eight choices, and where each gram meets them."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, choice: int, weight: np.ndarray) -> None:
        prefix = (byte >> (8 - choice)) | (1 << choice)
        self.bit = (byte >> (7 - choice)) & 1
        key = context << 8 | prefix
        self.nodes, self.at = np.unique(key, return_inverse=True)
        self.zeros = np.bincount(self.at, weight * (self.bit == 0), len(self.nodes))
        self.ones = np.bincount(self.at, weight * (self.bit == 1), len(self.nodes))
        self.total = self.zeros + self.ones

    def estimate(self) -> np.ndarray:
        right = np.where(self.bit == 1, self.ones[self.at], self.zeros[self.at])
        return (right + 0.5) / (self.total[self.at] + 1)


def subtree(grams: np.ndarray, weights: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, list[tuple]]:
    """Mixed estimates of each gram's eight bits over depths ``least`` to ``depth``; -1 where nothing was seen.

    Also a row (nearest context byte, choice and prefix, ln weighted probability) for
    each node at depth ``least``. Grams have their context in the bits above the byte.
    """
    byte, context = grams & 255, (grams >> 8) & ((1 << 8 * depth) - 1)
    mixed, tops = np.ones((len(grams), 8), np.float64), []
    for choice in range(8):
        below = seen = value = weighted = None
        for d in range(depth, least - 1, -1):
            level = _Level(context >> (8 * (depth - d)), byte, choice, weights)
            own, estimate = kt_log(level.zeros, level.ones), level.estimate()
            if d == depth:
                weighted, value = own, estimate
            else:
                parent = np.zeros(len(below.nodes), np.int64)
                parent[below.at] = level.at
                children = np.bincount(parent, weighted, len(level.nodes))
                weighted = np.logaddexp(own, children) - math.log(2)
                stop = np.exp(np.minimum(0.0, own - math.log(2) - weighted))[level.at]
                value = np.where(seen, stop * estimate + (1 - stop) * value, estimate)
            below, seen = level, level.total[level.at] > 0
        mixed[:, choice] = np.where(seen, value, -1.0)
        last = below.nodes >> 8 >> (8 * (least - 1)) if least else np.zeros(len(below.nodes), np.int64)
        tops += list(zip(last.tolist(), (below.nodes & 255).tolist(), weighted.tolist()))
    return mixed, tops


PACKED = "part int, lane int, n int, grams binary, weights binary"
MODEL = "kind int, part int, n int, grams binary, bits binary, node bigint, value double"
PRICED = "block bigint, part int, n int, grams binary, logp binary"


def _rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 64) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, at_once).columns))


def _map_packed(frame: DataFrame, fn, ddl: str, size: int = 2_000_000) -> DataFrame:
    """The rows that ``fn`` makes of a task's batches, in batches of about so many bytes of binary columns."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0
        for row in fn(batches):
            held.append(row)
            held_bytes += 64 + sum(len(x) for x in row if isinstance(x, bytes))
            if held_bytes > size:
                yield _batch(held, schema)
                held, held_bytes = [], 0
        if held:
            yield _batch(held, schema)
        release_memory()

    return frame.mapInArrow(run, ddl)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The summed grams of each (part, lane), of packed rows that come in this order."""
    key, held, size, floor = None, [], 0, 0
    for part, lane, n, grams, weights in _rows_of(batches):
        if key != (part, lane):
            if held:
                yield *key, *summed(held)
            key, held, size, floor = (part, lane), [], 0, 0
        held.append((unpack(grams, n), unpack(weights, n)))
        size += n
        if size > SUBTREE_GRAMS + 2 * floor:
            held = [summed(held)]
            size = floor = len(held[0][0])
    if held:
        yield *key, *summed(held)


def _trees(packed: DataFrame, depth: int) -> DataFrame:
    """For each part its grams with bits mixed down to depth 2, and sums for the nodes at depths 0 and 1."""
    most, least = SUBTREE_GRAMS, MODEL_GRAMS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, _, grams, weights in _merged(batches):
            yield part, 0, len(grams), pack(grams), pack(weights)

    def one(code: np.ndarray, weight: np.ndarray) -> Iterator[tuple]:
        mixed, tops = subtree(code, weight, depth, 2)
        bits, cuts = mixed.astype(np.float32), _part_cuts(code, depth)
        for a, b in zip(cuts, cuts[1:]):
            for k in range(a, b, least):
                e = min(k + least, b)
                yield 0, int(code[k] >> (8 * (depth - 1))), e - k, pack(code[k:e]), bits[k:e].tobytes(), None, None
        sums: dict[int, float] = {}
        for last, node, value in tops:
            sums[last << 8 | node] = sums.get(last << 8 | node, 0.0) + value
        # counts of (nearest byte, byte): what the two upper depths need besides those sums
        near = (code >> (8 * depth)) << 8 | code & 255
        pairs, at = np.unique(near, return_inverse=True)
        for kind, found in ((1, sums.items()), (2, zip(pairs.tolist(), np.bincount(at, weight).tolist()))):
            for node, value in found:
                yield kind, None, None, None, None, node, value

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Some whole subtrees, ``SUBTREE_GRAMS`` of grams or the one that is larger, are held at a time."""
        held, size = [], 0
        for _, _, grams, weights in _merged(batches):
            if held and size + len(grams) > most:
                yield from one(np.concatenate([g for g, _ in held]), np.concatenate([w for _, w in held]).astype(np.float64))
                held, size = [], 0
            held.append((grams, weights))
            size += len(grams)
        if held:
            yield from one(np.concatenate([g for g, _ in held]), np.concatenate([w for _, w in held]).astype(np.float64))

    rows = packed.select("part", "lane", "n", "grams", "weights").repartition("part", "lane").sortWithinPartitions("part", "lane")
    lanes = _map_packed(rows, merge, PACKED)
    return _map_packed(lanes.repartition("part").sortWithinPartitions("part"), grow, MODEL)


class Top:
    """Depths 0 and 1: at most 256 contexts with 255 nodes each."""

    def __init__(self, sums: dict[int, float], counts: dict[int, float]) -> None:
        keys = np.array(sorted(counts), np.int64)
        weight = np.array([counts[k] for k in keys.tolist()])
        byte, near = keys & 255, keys >> 8
        self.keys, self.keep, self.base, self.alone = keys, *(np.zeros((len(keys), 8)) for _ in range(3))
        for choice in range(8):
            one = _Level(near, byte, choice, weight)
            zero = _Level(np.zeros_like(near), byte, choice, weight)
            below = np.array([sums.get(n, 0.0) for n in one.nodes.tolist()])
            own1 = kt_log(one.zeros, one.ones)
            weighted1 = np.logaddexp(own1, below) - math.log(2)
            stop1 = np.exp(np.minimum(0.0, own1 - math.log(2) - weighted1))[one.at]
            parent = np.zeros(len(one.nodes), np.int64)
            parent[one.at] = zero.at
            own0 = kt_log(zero.zeros, zero.ones)
            weighted0 = np.logaddexp(own0, np.bincount(parent, weighted1, len(zero.nodes))) - math.log(2)
            stop0 = np.exp(np.minimum(0.0, own0 - math.log(2) - weighted0))[zero.at]
            seen = one.total[one.at] > 0
            # the mixture is base + keep * (what the deeper levels say)
            self.keep[:, choice] = np.where(seen, (1 - stop0) * (1 - stop1), 0.0)
            self.base[:, choice] = np.where(seen, stop0 * zero.estimate() + (1 - stop0) * stop1 * one.estimate(), zero.estimate())
            # without deeper levels the nearest byte's estimate stands in for them
            self.alone[:, choice] = np.where(seen, stop0 * zero.estimate() + (1 - stop0) * one.estimate(), zero.estimate())


def gram_log10(top: tuple[np.ndarray, ...], grams: np.ndarray, bits: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each gram's byte, from the arrays of :class:`Top`."""
    keys, keep, base, alone = top
    at = np.searchsorted(keys, (grams >> (8 * depth)) << 8 | grams & 255)
    return np.log10(np.where(bits < 0, alone[at], base[at] + keep[at] * bits)).sum(axis=1)


def gram_scores(blocks: DataFrame, depth: int = DEPTH, lane_blocks: int = LANE_BLOCKS) -> DataFrame:
    """The grams of each block by part, with the log10 probability of each."""
    if not 2 <= depth <= 6:
        raise ValueError("the depth is from 2 to 6")
    lanes = 1 + blocks.count() // lane_blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                grams, weights = training_grams(row, depth)
                cuts = _part_cuts(grams, depth)
                for a, b in zip(cuts, cuts[1:]):
                    yield row["block"], int(grams[a] >> (8 * (depth - 1))), b - a, pack(grams[a:b]), pack(weights[a:b])

    counted_ddl = "block bigint, part int, n int, grams binary, weights binary"
    counted = _map_packed(blocks.select("block", "words", "tokens", "held_out", "doc_words", "doc_bytes"), count, counted_ddl)
    packed = stored(counted.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")), "grams")
    model = stored(_trees(packed, depth), "model")

    upper = model.filter("kind > 0").groupBy("kind", "node").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, float]] = {1: {}, 2: {}}
    for kind, node, value in upper.toLocalIterator():  # at most 2 * 65 536 rows, whatever the corpus
        found[kind][node] = value
    joined = Top(found[1], found[2])
    top = blocks.sparkSession.sparkContext.broadcast((joined.keys, joined.keep, joined.base, joined.alone))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, n, grams, bits in _rows_of(batches):
            logp = gram_log10(top.value, unpack(grams, n), np.frombuffer(bits, np.float32).reshape(-1, 8).astype(np.float64), depth)
            yield -1, part, n, grams, logp.astype(np.float32).tobytes()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The rows of a part's model (block -1) come first, then its blocks."""
        key, known, logp, whole = None, [], [], False
        for block, part, n, grams, values, lane in _rows_of(batches):
            if key != (part, lane):
                key, known, logp, whole = (part, lane), [], [], False
            if block < 0:
                known.append(unpack(grams, n))
                logp.append(np.frombuffer(values, np.float32))
                continue
            if not whole:
                known, logp, whole = np.concatenate(known), np.concatenate(logp), True
                order = np.argsort(known)
                known, logp = known[order], logp[order]
            yield block, part, n, grams, logp[np.searchsorted(known, unpack(grams, n))].tobytes()

    priced = _map_packed(model.filter("kind = 0").select("part", "n", "grams", "bits"), price, PRICED)
    every = priced.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    asked = packed.select("block", "part", "n", "grams", F.lit(None).cast("binary").alias("logp"), "lane")
    return _map_packed(every.unionByName(asked).repartition("part", "lane").sortWithinPartitions("part", "lane", "block"), look_up, PRICED)


def text_log10(row: dict, grams: np.ndarray, logp: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each text of a block, from those of its distinct grams in order."""
    sizes = np.frombuffer(row["doc_bytes"], np.int64)
    total = np.zeros(len(sizes))
    for found, owner in gram_chunks(coded_bytes(row, depth), sizes, depth):
        first, order = int(owner[0]), np.argsort(found)  # sorted, they are looked up in half the time
        part = np.bincount(owner[order] - first, logp[np.searchsorted(grams, found[order])])
        total[first : first + len(part)] += part
    return total


def score_documents(docs: DataFrame, depth: int = DEPTH, block_words: int = BLOCK_WORDS, lane_blocks: int = LANE_BLOCKS) -> DataFrame:
    """Base score and model score (log10) of every document."""
    blocks = blocks_of(docs, block_words)
    words = _explode(blocks.select("block", "hashes", "checks", "counts"), "block bigint, number int, h bigint, g smallint, c bigint", _word_rows)
    same = Window.partitionBy("h", "g")  # a row for each block that has the word: counts come back in one shuffle
    totals = stored(words.select("block", "number", F.sum("c").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("first")), "word-counts")
    train, distinct = totals.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    counted = totals.selectExpr("block", "number", "c", "cast(null as binary) grams", "cast(null as binary) logp")
    priced = gram_scores(blocks, depth, lane_blocks).selectExpr("block", "part as number", "cast(n as bigint) as c", "grams", "logp")
    schema = arrow_schema(SCORES)

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = right.column("grams").is_null()
        rows = right.filter(is_word)
        counts = rows.column("c").to_numpy()[np.argsort(rows.column("number").to_numpy())]
        rows = right.filter(pc.invert(is_word))
        # parts are ranges of grams, so their order is that of the grams
        order = np.argsort(rows.column("number").to_numpy()).tolist()
        sizes, packed, values = (rows.column(c).to_pylist() for c in ("c", "grams", "logp"))
        grams = np.concatenate([unpack(packed[k], sizes[k]) for k in order])
        logp = np.concatenate([np.frombuffer(values[k], np.float32) for k in order]).astype(np.float64)
        base = np.log10((counts + 0.5) / (train + 0.5 * (distinct + 1)))
        parts = []
        for row in left.to_pylist():
            tokens, sizes = tokens_of(row), np.frombuffer(row["doc_words"], np.int64)
            starts = np.cumsum(sizes) - sizes
            add = lambda values: np.add.reduceat(values[tokens], starts)
            ids, nulls = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["null_ids"], bool)
            total, coded = text_log10(row, grams, logp, depth), np.frombuffer(row["doc_bytes"], np.int64)
            held = np.frombuffer(row["held_out"], bool)
            columns = [pa.array(ids, mask=nulls), pa.array(held), pa.array(sizes), pa.array(add((counts > 0).astype(np.int64))), pa.array(np.full(len(ids), train, np.int64)), pa.array(add(base)), pa.array(total), pa.array(-total / math.log10(2) / coded)]
            parts.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    answers = counted.unionByName(priced)
    return blocks.drop("hashes", "checks", "counts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
