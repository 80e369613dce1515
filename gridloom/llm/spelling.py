"""Spelling variants: words one edit apart, by an even partition into two segments.

A single edit leaves one half of a word untouched: its beginning, or its end moved by
the difference in length. So every word of length n is indexed under its first n // 2
code points and under the rest, and a word probes the index of words as long as itself
and one shorter, at the two places where a half can stand. What meets is verified by
the edit distance, and pairs that meet twice are kept once.

Halves that many words share ("inter", "ation") are hot. In such a list the edit lies
in the other part, which is cut evenly again: the keys become the untouched beginning
and end together, with a quarter of the word between them left open, then an eighth,
until lists are short or no more than one code point is open. All words of such a list
differ in one place only, so even then hardly a pair is made that isn't near. No list
is cut and no pair lost, and no list makes more candidates than ``cap`` times its
probes, but for those last ones, which hold a word for each letter at most.

Words are counted per task first. Keys are 64-bit hashes; equal hashes of different
keys only make candidates that verification drops.

Defined cases: a null or empty text has no runs; a null doc_id counts as empty in the
hash; repeated rows count repeatedly; other columns are ignored; no documents, or no
word frequent and long enough, give no rows. A run of letters is taken whole at any
length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_schema, chunks_of, release_memory, stored

#: Code points of a word at least, its occurrences at least, and how much more frequent its form is.
LENGTH, TIMES, FACTOR = 7, 2, 10
#: One run in so many loses a code point.
DELETE = 31
#: Words of a list at most before its keys are made longer.
CAP = 32
#: Distinct words a task holds before it hands on their counts, and the code points read at a time.
HELD, STEP = 200_000, 1 << 20

RUN = re.compile("[a-zÀ-ÿ]+")


def _slices(text: str) -> Iterator[str]:
    """Parts of a long text, cut where no run is."""
    at = 0
    while len(text) - at > STEP:
        end = at + STEP
        while end < len(text) and RUN.match(text[end]):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def thinned(doc_id: int | None, runs: Counter) -> Iterator[tuple[str, int]]:
    """The words of a document's lower-cased runs: some lose a code point, by their hash."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % DELETE == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run, n


def count_words(docs: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word and n: the words of at least ``length`` code points and ``times`` occurrences over all documents."""
    ddl = "word string, n bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for batch in batches:
            for part in chunks_of(batch):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    runs: Counter = Counter()
                    # A-Z only: bytes.lower() leaves all else
                    for piece in _slices((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                        runs.update(RUN.findall(piece))
                    for word, n in thinned(doc_id, runs):
                        if len(word) >= length:
                            counts[word] += n
                    if len(counts) > HELD:
                        yield full()
        yield full()
        release_memory()

    counted = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, ddl)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _key(word: str, base: Column) -> Column:
    """The hash of what is untouched: the first ``p`` and the last ``q`` code points of a word, for words of length ``base``."""
    w = F.col(word)
    return F.xxhash64(base, F.col("p"), F.col("q"), w.substr(F.lit(1), F.col("p")), w.substr(F.length(w) - F.col("q") + 1, F.col("q")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: the open part of the base length between the first ``p`` and the last ``q`` cut evenly."""
    opened = F.col("base") - F.col("p") - F.col("q")
    first = (opened / 2).cast("int")
    ways = F.array(F.struct((F.col("p") + first).alias("p"), F.col("q").alias("q")), F.struct(F.col("p").alias("p"), (F.col("q") + opened - first).alias("q")))
    cut = rows.withColumn("way", F.explode(ways)).withColumns({"p": F.col("way.p"), "q": F.col("way.q")})
    return cut.withColumn("key", _key("word", F.col("base"))).select("word", "n", "base", "p", "q", "key")


def _met(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Near pairs a, b with their counts: verified, each direction once. Words of one length meet with the smaller as a."""
    left = index.select("key", F.col("word").alias("a"), F.col("n").alias("na"), "base")
    right = probes.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("base").alias("base_b"))
    size = lambda c: F.length(c)
    both = left.join(right, "key").filter((F.col("base") == F.col("base_b")) & ((size("b") > size("a")) | (F.col("a") < F.col("b"))))
    return both.filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def near_pairs(words: DataFrame, cap: int = CAP) -> DataFrame:
    """Every pair of words (a, na, b, nb) that differ by one edit, once."""
    open_all = {"p": F.lit(0), "q": F.lit(0)}
    index = words.withColumn("base", F.length("word")).withColumns(open_all)
    probes = index.withColumn("base", F.explode(F.array("base", F.col("base") - 1)))
    found, level = None, 0
    while True:
        # keys with at most one open code point are as long as they get: their lists stay as they are
        index, probes = stored(_halves(index), f"index-{level}"), stored(_halves(probes), f"probes-{level}")
        sizes = index.withColumn("open", F.col("base") - F.col("p") - F.col("q")).groupBy("key").agg(F.count("*").alias("members"), F.max("open").alias("open"))
        hot = stored(sizes.filter((F.col("members") > cap) & (F.col("open") > 1)).select("key"), f"hot-{level}")
        ready = _met(index.join(hot, "key", "left_anti"), probes.join(hot, "key", "left_anti"))
        found = ready if found is None else found.union(ready)
        if hot.isEmpty():
            return found.distinct()
        index, probes, level = index.join(hot, "key", "left_semi"), probes.join(hot, "key", "left_semi"), level + 1


def variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, factor: int = FACTOR, cap: int = CAP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = stored(count_words(docs, length, times), "words")
    pairs = stored(near_pairs(words, cap), "near")
    both = pairs.union(pairs.select("b", "nb", "a", "na"))
    best = F.min_by(F.struct(F.col("b").alias("form"), F.col("nb").alias("form_n")), F.struct(-F.col("nb"), F.col("b")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.first("na").alias("own"), best.alias("best"))
    taken = F.col("best.form_n") >= factor * F.col("own")
    near = near.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, F.col("best.form_n")).alias("form_n"))
    near = stored(near, "forms")
    # a form is ``factor`` times as frequent, so a chain has few links; halved by each doubling
    chain = near.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = stored(chain.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "roots")
        if chain.filter("more").isEmpty():
            break
        chain = chain.select("word", "root")
    out = words.join(near, "word", "left").join(chain.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
