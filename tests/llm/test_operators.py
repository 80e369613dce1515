"""The ten operators against brute force on small fixtures, edge cases included."""

import hashlib
import html as htmllib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, ctw, decontaminate, html, language, licenses, near_dup, packing, quality, urls
from gridloom.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
#: Texts with every odd shape, beside ordinary ones.
TEXTS = [None, "", " \t\n ", "one", "a b c d", "A b\tc  d e", "x " * 3000, "é ü ñ " * 20, "same line.\nsame line.\nother line here, too.\n", "w " * 4 + "end"]


def documents(spark, texts, **more):
    """Documents with clashing extra columns."""
    rows = [(k, t, "words", "value") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, v string")


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}" for _ in range(n))


# chat


def conversation_rows():
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be kind"), (2, 0, "user", None), (2, 1, "assistant", "x <turn a>\n \\l \\ > y"), (3, 0, "assistant", said), (None, 0, "user", "lost")]
    rows += [(1, k, "user" if k % 2 else "assistant", f"{k} " + "word " * (k % 70)) for k in range(1, 60)]
    rows += [(4, 5, "user", "tie b"), (4, 5, "user", "tie a"), (4, 5, "user", "tie a"), (5, 0, None, "no role"), (6, 0, "assistant", "")]
    return rows


def test_chat_round_trip(spark):
    rows = conversation_rows()
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_conversations(turns, budget=100, history=30)
    got = {r.conv_id: r for r in chat.digest_windows(windows).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, items in groups.items():
        items.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in items)
        loss = "".join(t for _, r, t in items if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(items), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = windows.filter("conv_id = 1").orderBy("window_id").collect()
    assert len(parts) > 5 and all(w.n_tokens <= 100 or w.n_turns - w.n_repeated == 1 for w in parts)
    assert all(chat.parse(w.text)[0] == ("system", "be kind") for w in parts if w.n_repeated)
    assert sum(len(w.text) for w in parts) == got[1].formatted_chars


def test_chat_system_turn_is_retained(spark):
    """A system turn over the budget, and a turn over it, leave the system turn in every window."""
    rows = [(1, 0, "system", "law " * 300), *((1, k, "assistant", "word " * (400 if k == 3 else 5)) for k in range(1, 9))]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget=200, history=50)
    parts = windows.orderBy("window_id").collect()
    assert len(parts) > 2 and all(chat.parse(w.text)[0] == ("system", "law " * 300) for w in parts)
    assert chat.digest_windows(windows).first().n_turns == 9


def test_chat_many_empty_turns():
    """Turns without text are bounded, too: 100 000 of them take linear time."""
    window, n, most = chat._Window(1, 1024, 256, frozenset(["assistant"])), 0, 0
    for _ in range(100_000):
        row = window.add("assistant", "", chat.TURN_TOKENS)
        if row:
            n += row[2] - row[3]
            most = max(most, row[2])
    assert n + len(window.span) == 100_000 and most <= 256


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(none).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<", "a\\bl<g>", "\\l\\\\b", "</turn>\n<turn x>\n"])
def test_chat_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.parse(chat.render("r>", text)[0]) == [("r>", text)]


# urls


def test_urls(spark):
    cases = {
        "http://a.Example.COM/en/75?x": ("a.example.com", "/en/75", "example.com/en/7", "allow"),
        "https://other.com/en/1": ("other.com", "/en/1", "com/en/", "block"),
        "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "http://x.example.net/de/81": ("x.example.net", "/de/81", "example.net/de/8", "block"),
        "http://a.org/ES/": ("a.org", "/ES/", None, "allow"),
        "http://a.org?/es/": ("a.org", "", None, "allow"),
        "http://www.porn.io/": ("www.porn.io", "/", None, "block"),
        "http://www.popcorn.io/spamalot": ("www.popcorn.io", "/spamalot", None, "allow"),
        "http://cheap-pills.io/": ("cheap-pills.io", "/", None, "block"),
        "http://cheap.io/cheap": ("cheap.io", "/cheap", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(k, u, "h") for k, u in enumerate([*cases, None])]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [*cases.values(), ("", "", None, "allow")]


def test_urls_without_scheme(spark):
    cases = {"//casino.example/x": ("block", 1, 0), "www.porn.example/xxx": ("block", 2, 0), "cheap-pills": ("block", 0, 2), "popcorn.io/en/": ("allow", 0, 0), "hot-girls": ("allow", 0, 2), "hot-girls-cash-teen": ("block", 0, 4)}
    got = urls.filter_urls(spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")).orderBy("page_id").collect()
    assert [(r.verdict, r.n_strict, r.n_soft) for r in got] == list(cases.values())
    assert {(r.host, r.path, r.rule) for r in got} == {("", "", None)}


# licenses


def test_licenses(spark):
    texts = TEXTS + [
        "Released under the MIT License.", "released under an MIT license", "Licensed under CC BY-NC 4.0.", "cc-by, general   public\nlicense. All rights reserved; cc by",
        "Licensed under the Apache License, Version 2.0.", "xcc by general public", "This work is licensed under the GNU General Public License, version 3.",
    ]
    got = licenses.scan_licenses(documents(spark, texts)).orderBy("doc_id").collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text, r in zip(texts, got):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = word.findall(low)
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert r.n_words == len(words) and r.n_base == len(places)
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = [r.labels for r in got[len(TEXTS) :]]
    assert labels == ["mit", "", "cc-by,cc-by-nc", "cc-by,gpl,reserved", "apache-2.0", "", "gpl,gpl-3.0"]


def template_pattern(template):
    """A template as a regular expression over words, each with a space in front."""
    parts = re.findall(r"\[\[|\]\]|<<[^:>]*:\d+>>|[^\s\[\]<>]+", template)
    put = lambda p: "(?:" if p == "[[" else ")?" if p == "]]" else rf"(?: \S+){{0,{p.split(':')[1][:-2]}}}" if p.startswith("<<") else " " + re.escape(p)
    return re.compile("".join(map(put, parts)) + "(?= |$)")


def test_license_templates(spark):
    """Labels and scores of texts made from the templates, whole, varied and broken, against regular expressions."""
    rng, texts = random.Random(11), []
    for template in licenses.TEMPLATES.values():
        for k in range(8):
            words = []
            for p in re.findall(r"\[\[[^\]]*\]\]|<<[^:>]*:\d+>>|[^\s\[\]<>]+", template):
                if p.startswith("[["):
                    words += re.sub(r"<<[^>]*>>", "4", p[2:-2]).split() if rng.random() < 0.5 else []
                elif p.startswith("<<"):
                    words += [f"any{j}" for j in range(rng.randint(0, int(p.split(":")[1][:-2]) + (k == 7)))]
                else:
                    words.append(p)
            if k > 4:
                words[rng.randrange(len(words))] = "changed"
            texts.append("Before, this: " + " ".join(words).upper() + ". And after.")
    got = licenses.scan_licenses(documents(spark, texts)).orderBy("doc_id").collect()
    patterns = {label: template_pattern(t) for label, t in licenses.TEMPLATES.items()}
    for text, r in zip(texts, got):
        low = "".join(" " + w for w in re.findall(r"[0-9a-z]+", text.lower()))
        wanted = {label for label, p in patterns.items() if p.search(low)}
        assert set(filter(None, r.labels.split(","))) - set(r.base_labels.split(",")) == wanted, text
        sizes = [len(re.sub(r"\[\[.*?\]\]|<<.*?>>", " ", licenses.TEMPLATES[x]).split()) for x in wanted] + [len(p.split()) for p, x in licenses.PHRASES.items() if x in r.base_labels.split(",")]
        assert r.score == (max(sizes) / (max(sizes) + licenses.HALF) if sizes else 0.0)
    assert len({r.score for r in got}) > 8


def test_template_automaton():
    auto = licenses.compile_template("a [[b [[c]]]] <<x:2>> d")
    for text, wanted in (("a d", True), ("a b d", True), ("a b c d", True), ("a c d", True), ("a x y d", True), ("a x y z d", False), ("a b c x y d", True), ("b d", False)):
        assert auto.accepts([w.encode() for w in text.split()], 0) is wanted, text


# near duplicates


def brute_components(texts, percent=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return [len(s) for s in sets], [find(k) for k in range(len(texts))]


def near_texts():
    rng = random.Random(7)
    texts = list(TEXTS) + ["A B C D", "a b c d e"]
    base = prose(rng, 120, 5000).split()
    passage = prose(rng, 60, 5000)
    for _ in range(60):  # a large group of near copies, more than a list may hold
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 40
    for _ in range(50):  # a passage that many share
        texts.append(prose(rng, rng.randint(5, 60), 5000) + " " + passage)
    for _ in range(20):  # chains of small groups
        one = prose(rng, 80, 5000).split()
        for _ in range(3):
            one = one[:]
            one[rng.randrange(80)] = "changed"
            texts.append(" ".join(one))
    return texts


def test_near_duplicates(spark):
    texts = near_texts()
    sizes, wanted = brute_components(texts)
    got = near_dup.near_duplicates(documents(spark, texts), cap=8).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == wanted
    assert [r.kept for r in got] == [k == c for k, c in enumerate(wanted)]


def test_near_duplicates_lone_pivot(spark):
    """Pairs of hot lists are found where every pivot of their lists is far from all."""
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    first = words("v", 20)  # in six sets, so these come before the other hot words
    texts = [words("a", 100) + first + [f"m{k}"] for k in range(3)]
    texts.append(words("b", 100) + first)  # the pivot: no rare word
    texts += [words("c", 100) + first + words(f"r{k}x", 5) for k in range(2)]
    texts += [words(name, 100) + words(f"{name}{k}y", 30) for name in "abc" for k in range(10)]
    got = near_dup.near_duplicates(documents(spark, [" ".join(t) for t in texts]), words=1, cap=4).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 0, 0, 3, 4, 4, *range(6, 36)]


def test_near_duplicates_odd_ids(spark):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (5, "other words stand in this row now"), (None, text), (3, "other words stand in this row now"), (9, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3, False)] * 3 + [(None, None, True), (3, 3, True), (9, 3, False)], key=str)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicated_rows(spark):
    text = "a b c d e f g"
    rows = [(5, text, "x"), (5, text, "x"), (7, text, "y"), (None, text, "z"), (8, "quite other words stand here", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    got = sorted(((r.doc_id, r.n) for r in near_dup.deduplicated(docs).collect()), key=str)
    assert got == sorted([(5, "x"), (8, "z"), (None, "z")], key=str)


def test_stage_limit(spark):
    """A pair at 86 of 106 shingles is a near duplicate for a stage, not for the contract of op4."""
    words = [f"w{k}" for k in range(100)]
    changed = words[:30] + ["x"] + words[31:70] + ["y"] + words[71:]
    docs = documents(spark, [" ".join(words), " ".join(changed)])
    assert near_dup.near_duplicates(docs).filter("not kept").count() == 0
    assert [r.doc_id for r in near_dup.deduplicated(docs).collect()] == [0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# language


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    assert set(model[0]) == {"de", "en", "es", "fr"}
    rows = language.document_rows(docs).withColumn("declared", F.lit(None).cast("string"))  # the text and its host alone
    got = language.identify(rows, model).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("true")), "id")
    right, n, kept = got.agg(F.avg((F.col("lang") == F.col("true")).cast("int")), F.count("*"), F.avg(F.col("kept").cast("int"))).first()
    assert right > 0.97 and kept > 0.97


def test_language_posterior(spark):
    """The fused posterior of every row, computed again without Spark; joins by broadcast and by salts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, table = language.fit(docs)
    rng, rows = random.Random(6), []
    texts = [r.text for r in docs.select("text").orderBy("doc_id").limit(60).collect()]
    for k in range(150):
        text = rng.choice([None, "", "ab", " ".join((rng.choice(texts) or "x").split()[: rng.choice([3, 8, 80])])])
        host = rng.choice([None, "a.example.de", "b.example.de", "shop.x.co.uk", "x.co.uk", "one.fr"])
        rows.append((k, text, rng.choice([None, "de", "en-GB", "xx"]), host, host))
    got = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id bigint, text string, declared string, address string, host string"), (langs, table)).collect()}
    means = {}
    for k, text, *_ in rows:
        found = language.trigrams(text or "")
        means[k] = (len(found), table[:, found].astype(float).mean(axis=1)) if len(found) > 2 else (0, np.zeros(len(langs)))
    choice = {k: langs[int(np.argmax(m))] for k, (n, m) in means.items() if n}
    suffix = lambda h: language.SUFFIXES.get((h or "").rpartition(".")[2])
    said = lambda d: (d or "").split("-")[0]

    def rate(values, prior):
        known = [(v, choice[k]) for k, v in values if k in choice and v in langs]
        return min(0.98, max(0.5, (sum(a == b for a, b in known) + prior[0]) / (len(known) + prior[1])))

    p_declared = rate([(k, said(d)) for k, _, d, _, _ in rows], language.DECLARED_COUNTS)
    p_suffix = rate([(k, suffix(h)) for k, _, _, _, h in rows], language.SUFFIX_COUNTS)
    count = lambda test: np.array([sum(choice[k] == x for k, *_, h in rows if k in choice and h and test(h)) for x in langs], float)
    every = count(lambda h: True)
    base = (every + 1) / (every.sum() + len(langs))
    for k, text, declared, _, host in rows:
        n, mean = means[k]
        prior = np.full(len(langs), 1 / len(langs))
        if host and count(lambda h: h == host).sum():
            inner = count(lambda h: language.domain_of(h) == language.domain_of(host))
            domain = (inner + language.DOMAIN_ALPHA * base) / (inner.sum() + language.DOMAIN_ALPHA)
            own = count(lambda h: h == host)
            prior = (own + language.HOST_ALPHA * domain) / (own.sum() + language.HOST_ALPHA)
        scores = min(n, language.TEMPER) * mean + np.log(prior)
        for value, p in ((said(declared), p_declared), (suffix(host), p_suffix)):
            if value in langs:
                scores += np.log([p if x == value else (1 - p) / (len(langs) - 1) for x in langs])
        wanted = np.exp(scores - scores.max())
        assert got[k].confidence == pytest.approx(1 / wanted.sum(), abs=2e-5), rows[k]
        if sorted(scores)[-1] - sorted(scores)[-2] > 1e-6:
            assert got[k].lang == langs[int(np.argmax(scores))]
    assert language.domain_of("a.b.co.uk") == "b.co.uk" and language.domain_of("a.b.com") == "b.com" and language.domain_of("co.uk") == "co.uk"
    salted = language.identify(spark.createDataFrame(rows, "id bigint, text string, declared string, address string, host string"), (langs, table), max_hosts=1)
    assert {r.id: r for r in salted.collect()} == got


def test_language_fit_counts_repeated_rows_once(spark):
    rows = [(1, "ein text und noch einer", "de")] * 50 + [(2, "a text and one more", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    langs, table = language.fit(df, max_fit=2)
    assert langs == ["de", "en"] and np.allclose(table, language.fit(df.distinct())[1])


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    rows = [(1, None, None, None, None), (2, "", "fr-CA", "x.de", "h"), (3, "zq" * 400, "en", None, "h"), (4, "the and of this is the that with", "EN_us", "a.uk", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, declared string, address string, host string")
    got = {r.id: r for r in language.identify(df, model).collect()}
    assert got[1].lang is None and not got[1].kept
    assert got[2].lang == "fr" and got[2].suffix == "de" and not got[2].kept
    assert not got[3].kept
    assert got[4].lang == "en" and got[4].kept and got[4].declared == "en"
    assert language.identify(df.limit(0), model).count() == 0


# html


PAGE = """<!DOCTYPE html><html><head><title>no</title></head><body><header>head</header><nav><a href="/">menu</a></nav>
<div class="sidebar">side <p>more</p></div><article class="post-12"><h1>T &amp; U</h1><p>one\n two&nbsp;&eacute; <b>bold</b><br>three
<div class="cookie-notice">cookies</div><p class="advert">buy<br>now</p><form>f <input></form><script>var a="</p>";</script><p>four <a href=x>link</a>
<section id="comments"><p>reader</p></section></article><footer>&copy;</footer></body></html>"""


def test_html_extraction(spark):
    pages = [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", PAGE[: PAGE.index("four") + 4]), (3, None, None), (4, "http://h.x/3", ""), (5, "x", "plain <text"), (6, "http://k/", "<div><p>a<p>b</div>")]
    got = html.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == ["T & U one two é bold three four link", "T & U one two é bold three four", "", "", "plain <text", "a b"]
    assert [r.n_chars for r in got] == [len(r.text) for r in got]


def test_html_names_of_the_page(spark):
    """Names that tell of the page, or stand on what holds it, mute nothing."""
    frames = ['<body class="single has-sidebar">%s</body>', '<body class="comments-open">%s</body>', '<main class="with-sidebar">%s</main>', '<div class="layout-no-sidebar">%s</div>', '<article class="post tag-social">%s</article>']
    inner = '<p>kept text</p><div class="sidebar">side</div><article><article class="comment"><p>reader</p></article></article>'
    pages = [(k, f"http://h{k}.x/", f % inner) for k, f in enumerate(frames)]
    got = html.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == ["kept text"] * len(frames)


def test_html_layouts(spark):
    """Layouts named after what stands beside the article, titles, split articles, deep and generated markup."""
    long, other = "long text of the article, " * 20, "and the other half of it, " * 20
    cases = [
        (f'<div class="content-sidebar-wrap"><div class="text"><p>{long}</p></div><div class="sidebar">side</div></div>', long.strip()),
        (f'<article class="post comments-open"><h1 class="entry-header">Title</h1><p>{long}</p></article>', "Title " + long.strip()),
        (f'<div><div class="a"><p>{long}</p></div><div class="b"><p>{other}</p></div></div>', long.strip() + " " + other.strip()),
        ("<article><p>in the article</p></article>" + "<div>" * 5000 + "deep", "in the article"),
        (f'<article><p>{long}</p></article><div class="comment-list">{"<p>a reader says much</p>" * 60}</div>', long.strip()),
        (f'<p>{long}</p><div id="comments">{"<p>a reader says much</p>" * 60}</div>', long.strip()),
    ]
    pages = [(k, f"http://l{k}.x/", f"<body>{source}</body>") for k, (source, _) in enumerate(cases)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = html.extract_pages(df).orderBy("page_id").collect()
    assert [r.text for r in got] == [text for _, text in cases]
    assert html.extract_pages(df, max_bytes=0).orderBy("page_id").collect() == got


def test_html_many_paths(spark):
    """A host where every page has its own class names has one winner; each page still gives its text."""
    pages = [(k, "http://one.x/", f'<div class="c{chr(97 + k % 26)}x{chr(97 + k // 26 % 26)}q{"z" * (k // 676)}"><p>text of page {k}</p></div>') for k in range(2000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    winners = html.host_paths(df).collect()
    assert len(winners) == 1 and len(winners[0].keys) == 1
    assert html.extract_pages(df).filter("text = concat('text of page ', page_id)").count() == 2000


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1]
        parts = [" ".join(htmllib.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"<(?!/?b>)[^>]*>", article)]
        assert got[r.page_id] == " ".join(p for p in parts if p)


# language model


def test_context_tree(spark, monkeypatch):
    monkeypatch.setattr(ctw, "SUBTREE_GRAMS", 50)
    rng = random.Random(2)
    texts = [*TEXTS, *(prose(rng, rng.randint(1, 80)) for _ in range(40))]
    docs = {k: (t or "").encode().lower().split() + [b"\n"] for k, t in enumerate(texts)}
    depth = 4
    got = {r.doc_id: r for r in ctw.score_documents(documents(spark, texts), depth, block_words=500, lane_blocks=2).collect()}
    train = Counter(w for k, ws in docs.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    total, distinct = sum(train.values()), len(train)
    nodes, children = {}, {}

    def grams(ws):
        s = b"\n" * depth + b" ".join(ws)
        return [s[i - depth : i + 1] for i in range(depth, len(s))]

    def path(g):
        for j in range(8):
            yield (1 << j) | (g[-1] >> (8 - j)), (g[-1] >> (7 - j)) & 1

    for k, ws in docs.items():
        for g in grams(ws):
            for prefix, bit in path(g):
                for d in range(depth + 1):
                    key = (g[depth - d : depth], prefix)
                    nodes.setdefault(key, [0, 0])[bit] += zlib.crc32(str(k).encode()) % 5 != 1
                    if d < depth:
                        children.setdefault(key, set()).add(g[depth - d - 1 : depth])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    weights = {}

    def weighted(key):
        if key not in weights:
            own = kt(*nodes[key])
            weights[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(weighted((c, key[1])) for c in children[key])) - math.log(2)
        return weights[key]

    def log10(ws):
        out = 0.0
        for g in grams(ws):
            for prefix, bit in path(g):
                p = None
                for d in range(depth, -1, -1):
                    key = (g[depth - d : depth], prefix)
                    q = (nodes[key][bit] + 0.5) / (sum(nodes[key]) + 1)
                    if d == depth:
                        p = q
                    elif sum(nodes[(g[depth - d - 1 : depth], prefix)]):
                        stop = math.exp(kt(*nodes[key]) - math.log(2) - weighted(key))
                        p = stop * q + (1 - stop) * p
                    else:
                        p = q
                out += math.log10(p)
        return out

    for k, ws in docs.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in train for w in ws), total)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((train.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), rel=1e-9)
        assert r.score == pytest.approx(log10(ws), rel=1e-5)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(b" ".join(ws)), rel=1e-9)


def test_context_tree_reads_across_words(spark):
    """Held-out prose in a fixed order of words costs less than the same words shuffled."""
    rng = random.Random(5)
    sentence = "the old ferry leaves the harbour every morning before six and comes back late at night".split()
    texts = [" ".join(sentence[rng.randrange(4) :]) for _ in range(400)]
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    shuffled = sentence[:]
    rng.shuffle(shuffled)
    rows = [*enumerate(texts), (held[0], " ".join(sentence)), (held[1], " ".join(shuffled))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in ctw.score_documents(docs).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 5


def test_context_tree_chunks(monkeypatch):
    """Long texts are cut into chunks; the grams are those of the whole."""
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab ", k=n)) + b"\n" for n in (0, 1, 300, 0, 7, 90)]
    whole = ctw.grams_of(texts, 4)
    monkeypatch.setattr(ctw, "CHUNK", 13)
    assert all((a == b).all() for a, b in zip(ctw.grams_of(texts, 4), whole))
    assert len(whole[0]) == sum(map(len, texts))


def test_context_tree_is_a_distribution():
    """The probabilities of all bytes after a context add up to 1."""
    words = [b"abab", b"abc", b"b"]
    grams, owner = ctw.grams_of(words, 3)
    context = int(grams[1]) & ~255
    every = np.array([context | b for b in range(256)], np.int64)
    weights = np.concatenate([np.ones(len(grams)), np.zeros(256)])
    mixed, _ = ctw.subtree(np.concatenate([grams, every]), weights, 3, 0)
    assert np.prod(np.where(mixed < 0, 0.5, mixed)[len(grams) :], axis=1).sum() == pytest.approx(1.0)


# decontamination


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(str(k), prose(rng, rng.randint(14, 40), 400)) for k in range(12)] + [("short", "Alpha, beta"), ("none", None), ("7", "!!")]
    texts = list(TEXTS)
    for _ in range(60):
        text = prose(rng, rng.randint(1, 120), 400)
        if rng.random() < 0.5:
            words = rng.choice(items[:12])[1].split()
            a = rng.randrange(len(words) - 12)
            text += " " + " ".join(words[a : a + rng.choice([12, 13, 20])]).upper() + ". " + prose(rng, rng.randint(0, 300), 400)
        texts.append(text)
    texts += ["alpha BETA", "beta alpha " + "x " * 100 + "alpha-beta"]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    index = decontaminate.build_index(documents(spark, texts), shard_words=700)
    got = {r.doc_id: r for r in decontaminate.phrase_hits(index, benchmark).collect()}
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    windows = {}
    for item, text in items:
        ws = word.findall((text or "").lower())
        for s in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[s : s + 13]), set()).add(item)
    for k, text in enumerate(texts):
        ws, hit, found = word.findall((text or "").lower()), set(), set()
        for size in (2, 13):
            for s in range(len(ws) - size + 1):
                if names := windows.get(tuple(ws[s : s + size])):
                    hit |= set(range(s, s + size))
                    found |= names
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items) == (len(ws), len(hit), len(found)), text
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(ws))
    assert any(r.contaminated for r in got.values())
    # items in many broadcasts give the same
    assert {r.doc_id: r for r in decontaminate.phrase_hits(index, benchmark, block_bytes=100).collect()} == got
    near = decontaminate.proximity_hits(index, spark.createDataFrame([("n", "beta alpha")], "item_id string, text string"), 1).collect()
    assert {(r.doc_id, r.item_id) for r in near} == {(len(texts) - 2, "n"), (len(texts) - 1, "n")}
    assert decontaminate.phrase_hits(index, benchmark.limit(0)).filter("n_hit > 0").count() == 0


# quality


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality(spark):
    rng = random.Random(4)
    texts = TEXTS + [prose(rng, 300, 8) for _ in range(5)] + [prose(rng, 400, 100000) + ".\n" + prose(rng, 60, 100000) + "." for _ in range(5)] + ["menu | home | about | more\n" * 9 + "One real sentence. " * 2]
    got = quality.quality_report(documents(spark, texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, got):
        wanted = brute_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
        assert not (r.kept and r.base_failed)
    assert [r.kept for r in got[-6:]] == [True] * 5 + [False]
    cleaned = quality.clean(documents(spark, ["menu | home | about\n" + texts[-2]])).first()
    assert cleaned.text == texts[-2] and cleaned.n_words == "words"


def test_quality_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(60)) + "."
    docs = spark.createDataFrame([(1, text, "a", "b"), (None, None, None, None)], "doc_id bigint, text string, __gl_q_words string, __GL_Q_text string")
    assert [tuple(r) for r in quality.clean(docs).collect()] == [(1, text, "a", "b")]
    assert quality.clean(docs.limit(0)).columns == docs.columns


def test_quality_repeated_windows_of_long_texts(spark):
    """Windows that alternate, and places far into a long text."""
    rng = random.Random(8)
    turns = " ".join(["a b c d", "b c a d"][k % 2] for k in range(40))
    far = prose(rng, 30000, 10**9) + " one two three four " + prose(rng, 30000, 10**9) + " one two three four"
    for text, r in zip([turns, far], quality.quality_report(documents(spark, [turns, far])).orderBy("doc_id").collect()):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text)


def test_quality_guards():
    """Whatever line fails, its text matches a guard."""
    patterns = [re.compile(g) for g in quality._GUARDS]
    for line in ("a ** b ##", "A B C D E F G H I J K L M N O P Q R S T", "x | y > z", "- \r", "a -\u2028"):
        assert any(p.search("Text.\n" + line + "\nmore") for p in patterns), line


def test_quality_repeated_short_lines(spark):
    rng = random.Random(5)
    prose_line = prose(rng, 60, 100000) + "."
    menu = "Home\nAbout\nContact\n"
    said = "Yes.\nYes.\nOnce\n"
    cleaned = [r.text for r in quality.clean(documents(spark, [menu + prose_line + "\n" + menu + said, "Home \n" + prose_line + "\nHome"])).orderBy("doc_id").collect()]
    assert cleaned == [prose_line + "\n" + said, prose_line]
    lines = "\n".join(f"w{k}a w{k}b w{k}c" for k in range(40))
    got = quality.quality_report(documents(spark, [lines + "\n" + lines, lines])).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [False, True]


# packing


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("length"))
    docs = docs.unionByName(documents(spark, TEXTS).select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit(2).alias("length")))
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(pieces) == set(texts)
    for doc, rows in pieces.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [0], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert sum(r.length for r in rows) == len(ids) and all(r.length == 2048 for r in rows[1:])
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
        assert sum(3 * n > 2048 for _, n in items) <= 2
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 2048) * 1.03 + 1


@pytest.mark.parametrize("seed", range(5))
def test_pack_lengths(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 30)]) for _ in range(400)]
    bins, offsets = packing.pack_lengths(lengths, 100)
    used = Counter()
    for k in sorted(range(400), key=lambda k: (bins[k], offsets[k])):
        assert offsets[k] == used[bins[k]]
        used[bins[k]] += lengths[k]
    assert max(used.values()) <= 100
    assert packing.pack_lengths([], 100) == ([], [])


def test_pack_equal_lengths():
    """Whole sequences stand alone; equal lengths are matched in linear time."""
    bins, offsets = packing.pack_lengths([10] * 5 + [5] * 200_000, 10)
    assert len(set(bins[:5])) == 5 and not set(bins[:5]) & set(bins[5:]) and max(bins) == 100_004


def test_pack_repeated_rows(spark):
    """Equal rows are dealt over all parts."""
    docs = spark.createDataFrame([(None, "")] * 4000, "doc_id bigint, text string")
    got = packing.pack_documents(docs, tokenizer_path(), part_pieces=1000)
    assert got.count() == 4000
    parts = got.groupBy(F.shiftright("sequence_id", 40).alias("part")).count().collect()
    assert len(parts) == 5 and max(r["count"] for r in parts) < 1000


def test_empty_tables(spark):
    docs = documents(spark, ["x"]).limit(0)
    assert licenses.scan_licenses(docs).count() == 0
    assert quality.quality_report(docs).count() == 0
    assert packing.pack_documents(docs, tokenizer_path()).count() == 0
    assert ctw.score_documents(docs).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.extract_pages(pages).count() == 0
    assert urls.filter_urls(pages).count() == 0
    index = decontaminate.build_index(docs)
    assert decontaminate.phrase_hits(index, spark.createDataFrame([("a", "b c")], "item_id string, text string")).count() == 0


def test_registered_queries(spark):
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES)
    assert len(QUERIES) == 13 and json.dumps(list(QUERIES))
