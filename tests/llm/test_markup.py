"""Real markup: forms around pages, attributes, furniture within lists and lines, broken pages in linear time."""

import random
import time
from html.parser import HTMLParser

import pytest

from gridloom.llm import html, language

LONG = "long text of the article, " * 20
CASES = [
    (f'<form id="aspnetForm"><div class="nav">menu</div><div><p>{LONG}</p></div></form>', LONG.strip()),
    (f"<form><article><p>{LONG}</p></article></form>", LONG.strip()),
    (f"<article><p>{LONG}</p><form>Your name <input></form></article>", LONG.strip()),
    ('<div class="content" title="the hidden gem"><p>kept</p></div>', "kept"),
    ('<div class="content" data-x="a class=sidebar id=ad hidden"><p>kept</p></div>', "kept"),
    (f'<article><p>{LONG}</p></article><div class="sidebar" title="a class act"><p>side</p></div>', LONG.strip()),
    (f'<article><p>{LONG}</p><ul><li class="share"><p>Share this now</p></li><li>kept item</li></ul></article>', LONG.strip() + " kept item"),
    ('<article><p>one <span class="advert">BUY <b>NOW</b> <span>!</span></span>two</p><p>three</p></article>', "one two three"),
    ('<article><p>one <span class="advert">BUY NOW</p></article>', "one"),
    ('<article><pre>x = 1 <span class="comment"># why</span></pre></article>', "x = 1 # why"),
    ('<article><p class="advert">buy<br>now<p>kept<dl><dt class="ad">a<dd>b</dl></article>', "kept b"),
    ('<article><p hidden>gone</p><div class="share"><div><p>gone</p></div></div><p>kept</p></article>', "kept"),
    ('<article><address class="promo"><p>gone</p></address><p>kept</p></article>', "kept"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_markup(source, text):
    assert html.main_text(f"<body>{source}</body>", [])[1] == text


@pytest.mark.parametrize("piece", ["<!", "<", "<?", "<script>", "<head>", '<a "', "<a '\"", "<div>", "</section>", "<li class=ad>", "&", "<!--", "</script", "<p hidden>"])
def test_broken_pages_take_linear_time(piece):
    for source in (piece * (1_000_000 // len(piece)), "<p>x</p>" + "<div>" * 50_000 + piece * (500_000 // len(piece)) + ">"):
        began = time.process_time()
        html.read_page(source)
        language.without_markup(source)
        assert time.process_time() - began < 8


def test_without_markup():
    text = "a<script>x<b></script >b&amp;c<style>y<p>z< d <em class='>'>e &lt; f"
    assert language.without_markup(text).split() == ["a", "b", "c", "y", "z", "'>e", "f"]
    assert language.without_markup("") == "" and language.without_markup("<script> a <b").split() == ["a", "<b"]


class Slow(HTMLParser):
    """The text of an article by a tree of elements, for well-formed pages without doubtful names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        self.blocks += [text] if text else []

    def handle_starttag(self, tag, attrs):
        if tag in html.BREAKS:
            self.cut()
        if tag == "br":
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        gone = tag in html.FURNITURE or tag in html.RAW or html.hinted(names) == 2 or any(k == "hidden" for k, _ in attrs)
        self.open.append((tag, gone))

    def handle_endtag(self, tag):
        if tag in html.BREAKS:
            self.cut()
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(g for _, g in self.open):
            self.now.append(data)


def test_markup_against_a_parser():
    rng = random.Random(2)

    def inline(depth):
        parts = [rng.choice(["word", "two words ", " &eacute;&amp; ", "x<br>y", "\n"]) for _ in range(rng.randint(1, 4))]
        if depth and rng.random() < 0.5:
            tag, names = rng.choice(["b", "span", "em"]), rng.choice(["", ' class="x1"', ' class="share"', " title='hidden class=ad'", " hidden"])
            parts.insert(1, f"<{tag}{names}>{inline(depth - 1)}</{tag}>")
        return "".join(parts)

    def block(depth):
        names = rng.choice(["", "", ' class="text"', ' id="share"', ' class="big promo"', ' data-id="ad"', ' title="role=menu"'])
        if not depth or rng.random() < 0.4:
            return f"<p{names}>{inline(2)}</p>"
        tag = rng.choice(["div", "section", "blockquote", "ul", "nav", "aside"])
        inside = "".join(f"<li{rng.choice(['', ' class=share'])}>{block(depth - 1)}</li>" if tag == "ul" else block(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<{tag}{names}>{inside}</{tag}>"

    for _ in range(400):
        source = f"<html><body><nav>menu</nav><article><h1>Title {rng.random()}</h1>{''.join(block(3) for _ in range(4))}</article><footer>end</footer></body></html>"
        slow = Slow()
        slow.feed(source)
        slow.close()
        want = " ".join(slow.blocks)
        key = next(html._signed(n.key) for n in html.read_page(source)[1] if n.tag == "article")
        assert html.main_text(source, [key])[1] == want, source
