"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, hashed to 64 bits; its sketch is
the ``K`` least of those hashes. Documents are linked where 100 * intersection is at
least ``percent`` * union, confirmed on full sets.

1. Documents of equal sets collapse to the least of their ids (a plain aggregation).
2. Inverted lists over the retained values give candidate pairs. Lists of at most
   ``CAP`` sets give all their pairs of fitting sizes. A value in more lists than that
   is hot: it comes from a passage that many documents share, or a large group of
   near copies. A set of which at least half of the retained values are not hot
   still shares such a value with every partner (up to a chance below 1e-5 for a
   pair just at the limit, far lower else), so hot lists are not needed for it.
3. The other, saturated sets are indexed on full shingles by prefix filtering:
   with shingles ordered by how many saturated sets have them, linked sets share one
   of the first (1 - limit) * n + 1. Lists beyond ``CAP`` here hold near copies of one
   text. Two sets that meet in such lists only share none of their rare shingles, so
   the number of the others bounds their intersection; pairs that this rules out are
   never made. Members are compared with a pivot, the one with the least share of
   rare shingles; pairs still in different components after that are all compared,
   less those that the places of the list's value in both sets rule out.
4. The union-sketch estimate drops pairs far below the limit (by more than six
   standard deviations at the limit), and exact Jaccard on full sets decides. First
   every set is compared with its least candidate, then pairs across components.
5. Components come from alternating large and small stars, all in Spark.

Nothing that grows with the documents reaches the driver, no group is gathered in a
task, and no list is cut.

Defined cases: texts without words have an empty set and are linked with nothing;
rows that share a doc_id are one document; rows whose doc_id is null are linked with
nothing, with a null component, and kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BASE, ROLL, free_name, map_chunks, mix, span_hashes, stored, without

K, CAP, WORDS = 32, 32, 5
#: The limit of op4's contract, and that of stages without one.
PERCENT, STAGE_PERCENT = 85, 80
#: Ids that may be broadcast at once: 16 MB of them.
MAX_IDS = 2_000_000
#: Parts of a hot list's members in the comparison of all.
SALTS = 16

class Shingler:
    """Shingle hashes of many texts at once, with numpy."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word of lower-cased bytes."""
        raw = np.frombuffer(data, np.uint8)
        blank = np.concatenate([[True], self.white[raw], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        # words and what stands between them take turns
        return edges[::2], span_hashes(data, edges)[::2] if len(edges) else np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        starts, hashes = self.word_hashes(b"\n".join(parts))
        limits = np.cumsum([0] + [len(p) + 1 for p in parts])
        bounds = np.searchsorted(starts, limits)
        n, w = len(hashes), self.words
        rolled = np.zeros(max(0, n - w + 1), np.uint64)
        factor = 1
        for k in range(w):
            rolled += hashes[k : n - w + 1 + k] * np.uint64(factor) if n >= w else 0
            factor = factor * ROLL & (1 << 64) - 1
        rolled = mix(rolled).view(np.int64)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= w:
                out.append(np.unique(rolled[a : b - w + 1]))
            elif b > a:  # the whole sequence, told apart from shingles by its length
                total = np.uint64(b - a)
                for h in hashes[a:b]:
                    total = np.uint64((int(total) * BASE + int(h)) & (1 << 64) - 1)
                out.append(mix(np.array([total], np.uint64)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        return out


def sketches(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n, digest of the set, and its k least hashes."""
    made: list[Shingler] = []

    def sketch(columns: list[list]) -> list:
        if not made:
            made.append(Shingler(words))
        sets = made[0](columns[1])
        offsets = np.cumsum([0] + [min(k, len(s)) for s in sets]).astype(np.int32)
        values = np.concatenate([s[:k] for s in sets])
        return [columns[0], [len(s) for s in sets], [hashlib.md5(s.tobytes()).digest() for s in sets], pa.ListArray.from_arrays(offsets, values)]

    return map_chunks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), "doc_id bigint, n bigint, digest binary, sketch array<bigint>", sketch)


def full_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """id, n and all shingle hashes (packed) of the documents in ``ids`` (column id)."""
    made: list[Shingler] = []

    def pack(columns: list[list]) -> list[list]:
        if not made:
            made.append(Shingler(words))
        sets = made[0](columns[1])
        return [columns[0], [len(s) for s in sets], [s.tobytes() for s in sets]]

    texts = docs.selectExpr("cast(doc_id as bigint) id", "text")
    chosen = texts.join(_small(ids), "id", "left_semi")
    return map_chunks(chosen, "id bigint, n bigint, shingles binary", pack)


def _hot_values(postings: DataFrame, cap: int) -> DataFrame:
    """The values in more than ``cap`` lists: counted by partial sums, so no list is gathered."""
    return postings.groupBy("v").agg(F.count("*").alias("df")).filter(F.col("df") > cap).select("v")


def _small(ids: DataFrame, most: int = MAX_IDS) -> DataFrame:
    """``ids`` to be broadcast if there are at most ``most`` of them, else as it is."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def _pairs(members: Column, percent: int) -> Column:
    """Pairs (a, b) of a sorted array of (n, id) whose sizes allow a link."""
    return F.flatten(
        F.transform(
            members,
            lambda x, i: F.transform(
                F.filter(F.slice(members, i + 2, F.size(members)), lambda y: (y["n"] * percent <= x["n"] * 100) & (x["id"] != y["id"])),
                lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")),
            ),
        )
    )


def _list_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of the short lists; postings have v, id, n."""
    lists = postings.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("members")).filter(F.size("members") > 1)
    pairs = lists.select(F.explode(_pairs(F.col("members"), percent)).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("overlap"))


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose union-sketch estimate is not far below the limit."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("least", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    shared = F.size(F.array_intersect(F.array_intersect("least", "sa"), "sb"))
    limit = percent / 100
    margin = 6 * (limit * (1 - limit) / k) ** 0.5
    return both.filter(shared >= (limit - margin) * F.size("least")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose exact Jaccard similarity reaches the limit; sets have id, n, shingles."""

    def decide(columns: list[list]) -> list[list]:
        found = [[], []]
        for a, b, x, y in zip(*columns):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                found[0].append(a)
                found[1].append(b)
        return found

    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return map_chunks(both, "a bigint, b bigint", decide).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (its least id) for every id of the edges a, b."""
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: neighbours above a node go to its least neighbour
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("low").alias("y")).filter("x <> y").distinct()
        # small star: a node's lower neighbours, and itself, go to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(least, "x").select(F.col("y").alias("b"), F.col("low").alias("a")).filter("a <> b")
        now = stored(small.union(least.select(F.col("x").alias("b"), F.col("low").alias("a"))).select("a", "b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    ends = now.select(F.col("b").alias("id"), "a").union(now.select("a", "a"))
    return ends.groupBy("id").agg(F.min("a").alias("component"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _first_partner(pairs: DataFrame) -> DataFrame:
    """For every set its least candidate."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def near_links(docs: DataFrame, sets: DataFrame, percent: int = PERCENT, words: int = WORDS, k: int = K, cap: int = CAP) -> DataFrame:
    """Components (id, component) of the distinct sets (id, n, sketch) that have links."""
    postings = sets.select(F.explode("sketch").alias("v"), "id", "n", F.size("sketch").alias("kept"))
    hot_values = stored(_hot_values(postings, cap), "hot-values")
    short = postings.join(_small(hot_values), "v", "left_anti")
    cold = stored(_estimated(_list_pairs(short, percent), sets, percent, k), "pairs")

    saturated = postings.join(_small(hot_values), "v", "left_semi").groupBy("id").agg(F.count("*").alias("hot"), F.max("kept").alias("kept"))
    saturated = stored(saturated.filter(2 * F.col("hot") > F.col("kept")).select("id"), "saturated")
    prefix = stored(_prefix_postings(full_sets(docs, saturated, words), percent, cap), "prefix")
    short = _list_pairs(prefix.filter((F.col("df") <= cap) & (F.col("df") > 1)), percent)
    hot = prefix.filter(F.col("df") > cap).select("v", "id", "n", "common", "place")
    stars = _stars(hot, hot, percent)

    sure = stored(cold.union(_estimated(short, sets, percent, k)).union(_estimated(stars, sets, percent, k)).distinct(), "pairs")
    ids = stored(sure.select(F.col("a").alias("id")).union(sure.select("b")).union(hot.select("id")).distinct(), "ids")
    full = stored(full_sets(docs, ids, words).dropDuplicates(["id", "shingles"]), "sets")

    links = stored(_verified(_first_partner(sure), full, percent), "links")
    labels = stored(components(links), "labels")

    def joined(pairs: DataFrame) -> None:
        """Confirm pairs across components and bring the labels up to date."""
        nonlocal links, labels
        more = stored(_verified(pairs, full, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = stored(components(links), "labels")

    joined(_across(sure, labels))
    # members of hot lists that are still apart: another pivot for each component, then all pairs
    for last in (False, True):
        apart = _apart(hot, labels, last, percent)
        apart = stored(_estimated(_across(apart, labels), sets, percent, k), "pairs")
        # a pivot that links to nothing says nothing of the other members
        if not apart.isEmpty():
            joined(apart)
    return labels


def _apart(hot: DataFrame, labels: DataFrame, every: bool, percent: int) -> DataFrame:
    """Pairs of hot-list members from different components: each with the least member of another component, or all."""
    marked = hot.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = marked.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    # a row for each hot value: broadcast where few, so that no list meets in a task
    mixed = marked.join(_small(stored(groups.filter("low <> high"), "mixed"), MAX_IDS // 4), "v")
    # what is outside the least component of a list meets the list's members
    outside = mixed.filter("component <> low")
    if not every:
        return _stars(mixed, outside, percent)
    # in the list of a pair's first shared value, what follows it bounds the intersection
    rest = (F.col("n") - F.col("place") + 1).alias("rest")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    left = outside.select("v", F.col("id").alias("x"), F.col("n").alias("m"), rest.alias("shared"), F.col("component").alias("c"), salts)
    spread = mixed.select("v", "id", "n", rest, "component", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = spread.join(left, ["v", "salt"]).filter((F.col("component") != F.col("c")) & _may_link("n", "rest", "m", "shared", percent))
    return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def _may_link(n: str, common: str, m: str, shared: str, percent: int) -> Column:
    """Whether sets of n and m shingles can be linked by their common ones alone."""
    return (100 + percent) * F.least(common, shared) >= percent * (F.col(n) + F.col(m))


def _stars(members: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Each list's members paired with its head that has the least share of rare shingles."""
    rare = F.struct((1 - F.col("common") / F.col("n")).alias("rare"), "id")
    best = heads.groupBy("v").agg(F.min_by(F.struct("id", "n", "common"), rare).alias("p"))
    best = stored(best.select("v", F.col("p.id").alias("x"), F.col("p.n").alias("m"), F.col("p.common").alias("shared")), "pivots")
    pairs = members.join(_small(best, MAX_IDS // 4), "v").filter((F.col("id") != F.col("x")) & _may_link("n", "common", "m", "shared", percent))
    return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def _prefix_postings(full: DataFrame, percent: int, cap: int) -> DataFrame:
    """v, id, n, df for the first shingles of each set, rarest first.

    ``common`` is the number of the set's shingles that more than ``cap`` sets have.
    """

    def unpack(columns: list[list]) -> list:
        values = [np.frombuffer(b, np.int64) for b in columns[2]]
        offsets = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
        return [columns[0], columns[1], pa.ListArray.from_arrays(offsets, np.concatenate(values)), columns[3]]

    # rows of one id with different texts are different sets: told apart by a hash of the set
    packed = full.withColumn("part", F.xxhash64("shingles")).dropDuplicates(["id", "part"])
    tokens = map_chunks(packed.select("id", "n", "shingles", "part"), "id bigint, n bigint, v array<bigint>, part bigint", unpack)
    tokens = stored(tokens, "tokens").select("id", "n", "part", F.explode("v").alias("v"))
    # counts come by partial sums; a value alone in its list needs none
    counts = tokens.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = tokens.join(counts, "v", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    whole = Window.partitionBy("id", "part")
    # n - ceil(limit * n) + 1 places, in whole numbers
    common = F.sum((F.col("df") > cap).cast("bigint")).over(whole)
    ranked = ranked.withColumns({"place": F.row_number().over(whole.orderBy("df", "v")), "common": common})
    return ranked.filter(F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100) + 1).select("v", "id", "n", "df", "common", "place")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, k: int = K, cap: int = CAP) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    rows = stored(sketches(docs, words, k), "sketches")
    linked = rows.filter("n > 0 and doc_id is not null")
    classes = stored(linked.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    labels = near_links(docs, classes.select("id", "n", "sketch"), percent, words, k, cap)
    # rows of one doc_id are one document: their classes hang together
    shared = linked.select("doc_id", "digest").join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("b"), F.col("id").alias("a"))
    twice = shared.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low <> high")
    if not twice.isEmpty():
        more = shared.join(twice, "b")
        edges = more.select("a", F.col("low").alias("b")).union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = stored(components(edges), "labels")
    named = classes.select("digest", "id").join(labels, "id", "left")
    named = stored(named.select("digest", F.coalesce("component", "id").alias("component")), "named")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = STAGE_PERCENT, **params: int) -> DataFrame:
    """``docs`` with one row of each component, of the least id; rows of one id are told apart by their texts.

    Of rows of one id without words, one stays; rows with a null doc_id all stay.
    """
    row = free_name(docs, "row_number")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ids = rows.filter("doc_id is not null").select(F.col(row), F.col("doc_id").cast("bigint").alias("id"))
    named = rows.select(F.when(F.col("doc_id").isNotNull(), F.col(row)).alias("doc_id"), "text")
    judged = stored(near_duplicates(named, percent, **params).select(F.col("doc_id").alias(row), "n_shingles", "component_id").join(ids, row), "judged")
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")), F.when(F.col("n_shingles") == 0, F.col("id"))]
    first = judged.groupBy(*group).agg(F.min(F.struct("id", row)).alias("first")).select(F.col(f"first.{row}"))
    gone = judged.select(row).join(first, row, "left_anti")
    return without(rows, gone, F.col(row)).drop(row)
