"""HTML extraction by consensus host paths.

First pass: every page's containers are scored by the text of the blocks in them,
less their link text, and the page votes for the generalised path of its best one
(tags and classes from the body down, digits taken out). Votes are summed per host
in Spark and stored. Second pass: each page is read again with the paths that won on
its host, and the blocks inside the winning container give the text. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never
count.

A container is furniture by its tag, or by a class, id or role that says so. A form, or
a compound name with a word such as sidebar, does not count where the container holds
the page's main element or article or, on a page without these, most of its text:
layouts are named after what stands beside the article, and a form may be around the
whole page. Paragraphs, list items and elements within a line are furniture by their
names, too, with all that is in them.

Text rules: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one space.

Defined cases: null and empty html give an empty text; a page without a block gives
an empty text; a page that lacks its host's winning paths uses its own best
container; pages without a host share one empty host; repeated rows give repeated
results; other columns are ignored; nesting may be of any depth.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_chunks, stored

#: Elements whose content is never page text.
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
#: Elements that are page furniture.
FURNITURE = frozenset("nav header footer aside form button dialog menu".split())
#: Parts of class names and ids that mark furniture.
HINTS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header menu modal nav navbar "
    "navigation newsletter alert consent gdpr notice pagination popup promo promoted recommended related replies reply share sharing sidebar signup social sponsor sponsored subscribe toc toolbar widget".split()
)
#: Words after which a hint tells of the page, as in has-sidebar, and elements whose names say nothing of furniture.
QUALIFIERS = frozenset("has have with without no not hide".split())
WHOLE = frozenset("html body main".split())
#: Furniture words that layouts are named after, too.
LAYOUT = frozenset("banner footer header menu nav navbar navigation sidebar toolbar widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Last words of names that tell a state, as in comments-open.
STATES = frozenset("open closed enabled disabled on off visible active collapsed".split())
#: Elements that hold other blocks, and those that only end a block.
CONTAINERS = frozenset("html body main article section div ul ol dl table tbody thead tfoot tr td th figure fieldset details center blockquote".split()) | FURNITURE
BREAKS = frozenset("p br hr h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption summary legend option".split()) | CONTAINERS
#: Elements that the next of them ends, and elements without an end.
ITEMS = frozenset("li dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Containers that usually hold the article, and parts of names that say so.
FAVOURED = frozenset("article main".split())
GOOD = frozenset("article body content entry main post story text".split())

#: Share of a host's votes that a path needs to win, and bytes of winners that may be broadcast.
MIN_VOTES, MAX_BYTES = 0.1, 32 << 20
#: What a container passes on to the one around it, and characters of a path that are written out.
SHARE, PATH_CHARS = 0.7, 400

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>", re.S)
#: One attribute after another, so that nothing inside a value counts as a name.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?|\"[^\"]*\"|'[^']*'")
_NAMED = frozenset(("class", "id", "role", "hidden"))
_HEAD_END = re.compile(r"</head\s*>|<body", re.I)
_PARTS = re.compile(r"[a-z]+")
_HOST = re.compile(r"://([^/?#]*)", re.S)


def hinted(names: str) -> int:
    """2 if a name says furniture, 1 if it may tell of a layout, else 0; after a word of ``QUALIFIERS`` it only says what the page has."""
    found = 0
    for name in names.lower().split():
        parts = _PARTS.findall(name)
        for k, part in enumerate(parts):
            if part in QUALIFIERS:
                break
            if part in HINTS:
                state = k + 1 < len(parts) and parts[-1] in STATES
                found = max(found, 0 if state else 1 if len(parts) > 1 and part in LAYOUT else 2)
    return found


class Node:
    """An open or closed container."""

    __slots__ = ("tag", "parent", "label", "key", "skip", "weak", "holds", "outer", "weight", "score", "chars")

    def __init__(self, tag: str, names: str, parent: Node | None, hidden: bool) -> None:
        parts = set(_PARTS.findall(names.lower()))
        self.tag, self.parent = tag, parent
        # an article in another is a comment or the like
        self.outer = tag in WHOLE or tag == "article" and not (parent and parent.holds)
        self.holds = tag == "article" or parent is not None and parent.holds  # inside an article
        hint = 0 if self.outer else hinted(names)
        self.skip, self.weak = hidden or tag in FURNITURE and tag != "form" or hint == 2, hint == 1 or tag == "form"
        self.label = ".".join([tag, *sorted(re.sub(r"\d+", "", c) for c in names.lower().split())])
        self.key = xxhash.xxh3_64_intdigest(self.label.encode("utf-8", "surrogatepass"), parent.key if parent else 0)
        self.weight = 2.0 if tag in FAVOURED or parts & GOOD else 0.5 if tag in ("html", "body") else 1.0
        self.score, self.chars = 0.0, 0

    def path(self) -> str:
        """The labels from the page down, the last ones where they are long."""
        out, size, node = [], 0, self
        while node.parent is not None and size < PATH_CHARS:
            out.append(node.label[:PATH_CHARS])
            size += len(out[-1]) + 1
            node = node.parent
        return ">".join(reversed(out))[-PATH_CHARS:]


def _named(attributes: str) -> dict[str, str]:
    """The attributes that tell what an element is; of repeated ones, the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name = (m[1] or "").lower()
        if name in _NAMED:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _furniture(named: dict[str, str], least: int) -> bool:
    """Whether an element that is no container counts as furniture by its own names, or is hidden."""
    return "hidden" in named or hinted(" ".join(named.values())) >= least


def _judge(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks that are not in furniture. Nodes come after their parents."""
    for node in nodes[1:]:
        node.skip = node.skip or node.parent.skip
    for node, text, _ in blocks:
        if not node.skip:
            node.chars += len(text)
    total, main = sum(n.chars for n in nodes), set()
    for node in reversed(nodes[1:]):
        if not node.skip:
            node.parent.chars += node.chars
            if (node.outer and node.chars or node in main) and node.tag not in ("html", "body"):
                main.add(node.parent)
    has_main = any(n.outer and n.chars and n.tag in FAVOURED for n in nodes)
    for node in nodes[1:]:
        named = node.weak and node not in main and (has_main or 2 * node.chars <= total)
        node.skip = node.skip or node.parent.skip or named
    return [b for b in blocks if not b[0].skip]


def read_page(source: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Blocks (container, text, characters in links) in page order without furniture, and all containers, scored."""
    root = Node("", "", None, False)
    nodes, stack, blocks = [root], [root], []
    opened: Counter = Counter()
    held: list[str] = []
    linked, in_link, at, headless = 0, False, 0, False
    # what mutes: the element's name, how many of that name are open in it, and how deep the stack was
    mute, inner, depth, code = "", 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append((stack[-1], text, linked))
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not mute:
            held.append(html.unescape(raw) if "&" in raw else raw)
            linked += len(raw) if in_link else 0

    last = source.rfind(">") + 1  # no tag ends behind it
    found = _TAG.search(source, 0, last)
    while found:
        put(source[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        block = name in BREAKS and name != "br"
        if name in BREAKS:
            flush()
        if mute:
            if mute == "p":
                mute = "" if block else mute
            elif mute in ITEMS:
                mute = "" if name in ITEMS and len(stack) <= depth else mute
            elif name == mute:
                inner += -1 if closing else 1
                mute = mute if inner else ""
        if name in ("pre", "code"):
            code = max(0, code + (-1 if closing else 1))
        if name == "a":
            in_link = not closing
        elif name in RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name in CONTAINERS:
            in_link = False
            if closing:
                while opened[name]:
                    opened[stack[-1].tag] -= 1
                    if stack.pop().tag == name:
                        break
                if len(stack) < depth:
                    mute = ""  # what was left open ends with the element around it
            else:
                named = _named(attributes)
                node = Node(name, f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}", stack[-1], "hidden" in named or bool(mute))
                nodes.append(node)
                stack.append(node)
                opened[name] += 1
        elif name == "head" and not closing and not headless:
            end = _HEAD_END.search(source, at)
            at, headless = (end.start(), False) if end else (at, True)
        if name and not mute and not closing and attributes and name not in CONTAINERS and name not in HEADINGS and name not in VOID and not (code and not block):
            # compound names count for blocks only
            if _furniture(_named(attributes), 1 if block else 2):
                mute, inner, depth = name, 1, len(stack)
        found = _TAG.search(source, at, last)
    put(source[at:])
    flush()
    blocks = _judge(nodes, blocks)
    for node, text, links in blocks:
        worth, share = max(0.0, len(text) - 2 * links), 1.0
        while node is not None and share > 0.1:
            node.score += worth * share * node.weight
            node, share = node.parent, share * SHARE
    return blocks, nodes


def best_container(nodes: list[Node]) -> Node:
    return max(nodes, key=lambda n: n.score)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def vote(source: str) -> tuple[int, str, float]:
    """The page's choice of a path (its key and how it reads), and how much text backs it."""
    _, nodes = read_page(source)
    best = best_container(nodes)
    return _signed(best.key), best.path(), best.score


def main_text(source: str, winners: list[int]) -> tuple[str, str]:
    """(path used, text); ``winners`` are the keys of the host's paths, best first."""
    blocks, nodes = read_page(source)
    found = {k: n for n in reversed(nodes) if n.score > 0 and (k := _signed(n.key)) in winners} if winners else {}
    best = next((found[w] for w in winners if w in found), None)
    chosen = {n for n in nodes if n.key == best.key} if best is not None else {best_container(nodes)}
    for node in nodes[1:]:  # parents come first
        if node.parent in chosen:
            chosen.add(node)
    path = (best or best_container(nodes)).path()
    return path, " ".join(text for node, text, _ in blocks if node in chosen)


def host_of(url: str | None) -> str:
    found = _HOST.search(url or "")
    return found[1].lower() if found else ""


def host_paths(pages: DataFrame, min_votes: float = MIN_VOTES) -> DataFrame:
    """The winning paths of every host, best first: columns host, keys, bytes.

    A path wins with ``min_votes`` of the host's votes, or with the most of all (of
    ties, the one that more text backs): at most ``1 + 1 / min_votes`` win.
    """

    def votes(columns: list[list]) -> list[list]:
        chosen = [vote(h or "") for h in columns[1]]
        return [[host_of(u) for u in columns[0]], *(list(x) for x in zip(*chosen))]

    counted = map_chunks(pages.select("url", "html"), "host string, key bigint, path string, score double", votes).filter("score > 0")
    counted = stored(counted.groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.min("path").alias("path")), "host-votes")
    rank = F.struct(F.col("n"), F.round("score", 3).alias("s"), F.col("key"))
    total = counted.groupBy("host").agg(F.sum("n").alias("total"), F.max(rank).alias("top"))
    won = counted.join(total, "host").filter((F.col("n") >= min_votes * F.col("total")) | (F.col("key") == F.col("top.key")))
    ranked = F.reverse(F.array_sort(F.collect_list(rank)))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["key"]).alias("keys")).withColumn("bytes", F.length("host") + 8 * F.size("keys") + 32)


def extract_pages(pages: DataFrame, min_votes: float = MIN_VOTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, url, text, n_chars and the path used, for every page."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    winners = stored(host_paths(pages, min_votes), "host-paths")
    size = winners.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    host = F.coalesce(F.regexp_extract("url", "(?s)://([^/?#]*)", 1), F.lit(""))
    keyed = pages.withColumn("host", F.lower(host))
    # winners of many hosts are joined by shuffling, salted against hot ones
    if size <= max_bytes:
        joined = keyed.join(F.broadcast(winners), "host", "left")
    else:
        salts = 16
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def extract(columns: list[list]) -> list[list]:
        texts = [main_text(h or "", w or []) for h, w in zip(columns[2], columns[3])]
        return [columns[0], columns[1], [t for _, t in texts], [len(t) for _, t in texts], [p for p, _ in texts]]

    return map_chunks(joined.select("page_id", "url", "html", "keys"), "page_id bigint, url string, text string, n_chars bigint, path string", extract)
