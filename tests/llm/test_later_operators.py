"""Spelling variants, centroid clusters and BPE against brute force; hashes of words made to collide."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import bpe, clusters, near_dup, packing, quality, spelling
from gridloom.llm.common import without
from gridloom.llm.queries import tokenizer_path

ODD = [None, "", " \t\n ", "one", "é ü ñ " * 20, "Straßenbahnen × strassenbahnen÷", "İstanbul ſtraße", "x" * 3000]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    """The contract of the spelling query, word by word."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    beside = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(beside[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


@pytest.mark.parametrize("cap", [1, 3, 32])
def test_spelling_variants(spark, cap):
    rng = random.Random(cap)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(12)]

    def word():
        w = list(min(rng.choice(stems), rng.choice(stems)))
        for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "zz", "ÿ"])
        return "".join(w).title() if rng.random() < 0.2 else "".join(w)

    rows = [(k, " ".join(word() for _ in range(400))) for k in range(8)] + [(None, "abcabcab abcabcab abcabcaz"), (3, "abcabcab")] + [(100 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, "w", 1, "k") for r in rows], "doc_id bigint, text string, word string, n int, key string")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(docs, cap=cap).collect())
    want = variants(rows)
    assert len(want) > 100 and any(w[1] for w in want) and got == want


def test_spelling_hot_halves(spark):
    """A list of thousands of words with one half in common makes few candidates, at each depth."""
    rng = random.Random(1)
    words = {"begin" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)}
    words |= {w[:7] + "x" + w[8:] for w in list(words)[:300]}
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    got = {(r.a, r.b) for r in spelling.near_pairs(frame).collect()}
    by_cut = {}
    for w in words:
        for k in range(len(w)):
            by_cut.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    assert got == {tuple(sorted(p)) for group in by_cut.values() for p in itertools.combinations(group, 2)}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(empty).count() == 0


def lloyd(rows, k, rounds):
    """Whole-number k-means by full comparisons, in Python's integers."""
    vectors = [(i, [int(np.floor(256 * float(v))) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in vectors if i is not None)[:k]
    centroids = [x for _, x in start]

    def assigned():
        found = []
        for _, x in vectors:
            found.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)))
        return found

    for _ in range(rounds):
        groups = {}
        for (_, x), (_, j) in zip(vectors, assigned()):
            groups.setdefault(j, []).append(x)
        for j, group in groups.items():
            centroids[j] = [sum(column) // len(group) for column in zip(*group)]
    final = assigned()
    inertia = Counter()
    for d, j in final:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(vectors, final))


def clustered(spark, rows, **params):
    frame = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id bigint, embedding array<float>, cluster int, n int")
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in clusters.clustered(frame, **params).collect())


def test_centroid_clusters(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.3, (9, 64))
    points = np.float32(middle[rng.integers(0, 9, 500)] + rng.normal(0, 0.1, (500, 64)))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(points)]
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(None, rows[1][1]), (7, rows[2][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64)]
    assert clustered(spark, rows) == lloyd(rows, 40, 5)


def test_centroid_cluster_ties(spark):
    """Points of a small grid: many equal distances, repeated points and empty clusters."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) / 256 for v in [*rng.integers(0, 3, 4), *[0] * 60]]) for i in range(300)]
    assert clustered(spark, rows) == lloyd(rows, 40, 5)
    assert clustered(spark, rows[:5]) == lloyd(rows[:5], 40, 5)
    assert clustered(spark, rows[:1]) == lloyd(rows[:1], 40, 5)
    assert clustered(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="beyond the range"):
        clustered(spark, [(1, [1e9] * 64)])


def test_bounds_save_comparisons():
    """Rounds after the first compare a few of the centroids, and agree with full comparisons."""
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (8, 64))[rng.integers(0, 8, 4000)] + rng.integers(-90, 90, (4000, 64))
    c = x[:40].copy()
    state = clusters.Bounds(c, None, 10).fresh(x)
    for length in (10, 10, 7, 5, 5):
        sums = np.stack([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(40)])
        moved, c = np.sqrt(((sums - c) ** 2).sum(1).astype(float)), sums
        bounds = clusters.Bounds(c, moved, length)
        *state, used = bounds.again(x, *state)
        assert np.array_equal(state[0], bounds.to_all(x).argmin(1))
        far = np.sqrt(bounds.to_all(x).astype(float))
        assert (np.take_along_axis(far, state[2].astype(int), 1) >= state[3]).all() and (far[np.arange(len(x)), state[0]] <= state[1]).all()
    compared = np.where(used > bounds.length, 40, used + 1)
    assert compared.mean() < 10


PIECES = ["a", "foo", "bar.", "\n", " ", "  ", "\t", "é", "ñandú", "<|endoftext|>", "<|", "it's", "'s", "'", "'re", " ", "　", "123", "!!", "x\ny", "日本", "\r\n", "\x85", "A\n\nB", "Ġ", "\x1c", "\x00", "́", "😀", "“", "�", "٣"]


def odd_texts(rng, n):
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return texts + ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(n // 10)]


def test_forced_boundaries():
    """Ids of fragments put together are the tokenizer's of whole texts, also where little is kept."""
    rng = random.Random(5)
    for cache in (bpe.CACHE_FRAGMENTS, 20):
        coder = bpe.ForcedBoundaryBPE(tokenizer_path(), cache)
        for _ in range(20):
            texts = odd_texts(rng, 200)
            want = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
            for text, ids, one in zip(texts, coder.encode(texts), want):
                assert ids.tolist() == one.ids, text
                assert coder.decode(ids) == coder.tokenizer.decode(one.ids, skip_special_tokens=False)
    loose = [rng.randrange(50257) for _ in range(5000)]
    assert coder.decode(np.array(loose)) == coder.tokenizer.decode(loose, skip_special_tokens=False)
    assert coder.encode([]) == [] and coder.encode([""])[0].tolist() == []
    whole = np.frombuffer("word and word, 12 words\nmore".encode(), np.uint8)
    assert [bytes(p) for p in np.split(whole, coder.cuts(whole))][:3] == [b"word", b" and", b" word"]


def test_bpe_round_trip(spark):
    rng, coder = random.Random(7), bpe.ForcedBoundaryBPE(tokenizer_path())
    texts = [*ODD, *odd_texts(rng, 60), "word " * 50_000, "é" * 100_000, "word " * 3]
    docs = spark.createDataFrame([(k if k else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in bpe.round_trip(docs, tokenizer_path()).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        ids, r = coder.tokenizer.encode(text or "", add_special_tokens=False).ids, got[k if k else None]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    coded = bpe.encode_documents(docs, tokenizer_path())
    back = {r.doc_id: r.text for r in bpe.decode_documents(coded, tokenizer_path()).collect()}
    assert back == {k if k else None: t or "" for k, t in enumerate(texts)}
    assert bpe.round_trip(docs.limit(0), tokenizer_path()).count() == 0


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_in_powers(spark, n):
    """Words that every polynomial modulo a power of two confuses are told apart."""
    a, b = thue_morse(n)
    one, two, three, four = near_dup.Shingler()([f"{a} v w x y", f"{b} v w x y", a, b])
    assert one.tolist() != two.tolist() and three.tolist() != four.tolist()
    coder = bpe.ForcedBoundaryBPE(tokenizer_path())
    for text, ids in zip([f"x {a}", f"x {b}"], coder.encode([f"x {a}", f"x {b}"])):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert packing.pack_documents(docs, tokenizer_path()).select("ids_crc32").distinct().count() == 2


def test_helper_names_of_documents(spark):
    """Columns that helpers would like to use keep their values."""
    rows = [(1, "a b c d e f", 5, "r", "g"), (2, "a b c d e f", 6, "s", "h"), (3, "quite another text of words", 7, "t", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_number int, _row_number string, gone string")
    assert sorted(map(tuple, near_dup.deduplicated(docs).collect())) == [rows[0], rows[2]]
    ids = spark.createDataFrame([(2,)], "gone bigint")
    assert sorted(map(tuple, without(docs, ids, docs.doc_id).collect())) == [rows[0], rows[2]]
    assert quality.clean(docs).columns == docs.columns
