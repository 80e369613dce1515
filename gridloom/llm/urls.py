"""URL filters: host and path rules over a weighted vocabulary of terms.

Aho-Corasick counts vocabulary terms in the lower-cased url. A term counts only
where no letter or digit touches it on either side. One strict term rejects the url;
so do at least ``min_soft`` distinct soft terms whose weights add up to ``min_weight``.
A rule that fits the url's host
(or a parent domain of it) and the start of its path overrides the vocabulary; the
longest fitting rule wins.

Defined cases: a null url, or one without ``://``, has empty host and path and no
rule; terms count in every url that is not null; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_chunks

#: Terms that reject a url alone.
STRICT = (
    "bestiality", "bitporno", "blowjob", "brazzers", "camgirl", "camgirls", "camsex", "casino", "casinos", "chaturbate", "cialis", "cumshot", "deepthroat",
    "erotica", "escort", "escorts", "fuck", "gangbang", "hentai", "keygen", "keygens", "levitra", "livejasmin", "malware", "milf", "milfs",
    "phishing", "porn", "pornhub", "porno", "pornstar", "redtube", "sexcam", "sexcams", "sexchat", "spam", "spyware", "trojan",
    "viagra", "warez", "webcamsex", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: Terms of which several distinct ones reject a url, by how much they say: 1 little, 2 more, 3 much.
SOFT = {
    "adult": 2, "bet": 2, "bets": 2, "betting": 3, "bonus": 2, "cam": 2, "cams": 2, "cash": 1, "cheap": 2, "crack": 2, "cracked": 3, "credit": 1, "dating": 2, "deal": 2,
    "deals": 2, "discount": 2, "download": 1, "erotic": 3, "free": 2, "gambling": 3, "girls": 1, "hot": 1, "jackpot": 3, "leaked": 2, "loan": 2, "loans": 2, "lottery": 2,
    "naked": 3, "nude": 3, "nudes": 3, "nulled": 3, "payday": 3, "pharmacy": 2, "pills": 3, "poker": 3, "prize": 2, "roulette": 3, "serial": 1, "sex": 3, "sexy": 3,
    "slots": 3, "teen": 1, "teens": 1, "torrent": 2, "torrents": 2, "voyeur": 3, "webcam": 2, "win": 2, "winner": 2, "xx": 2,
}
MIN_SOFT, MIN_WEIGHT = 2, 4
#: Fixed values: (verdict, host, path start) of the production rule list.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_RESULT = "page_id bigint, host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint, weight bigint"
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    found = _PARTS.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def best_rule(host: str, path: str, table: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; ``table`` has rules by host."""
    found, rest = [], host
    while rest:
        found += [(rest + start, verdict) for start, verdict in table.get(rest, ()) if path.startswith(start)]
        rest = rest.partition(".")[2]
    return max(found, key=lambda x: (len(x[0]), x[0]), default=None)


def count_terms(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int]:
    """(places of strict terms, distinct soft terms, their weights) of a lower-cased url; strict terms have the weight 0."""
    strict, soft = 0, {}
    for end, (term, weight) in automaton.iter(url):
        before, after = url[end - len(term) : end - len(term) + 1], url[end + 1 : end + 2]
        if end - len(term) >= 0 and before.isascii() and before.isalnum() or after.isascii() and after.isalnum():
            continue
        if weight:
            soft[term] = weight
        else:
            strict += 1
    return strict, len(soft), sum(soft.values())


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: dict[str, int] = SOFT, min_soft: int = MIN_SOFT, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    table: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, start in rules:
        table.setdefault(host, []).append((start, verdict))
    made: list[ahocorasick.Automaton] = []

    def automaton() -> ahocorasick.Automaton:
        if not made:
            made.append(ahocorasick.Automaton())
            for term, weight in (soft | dict.fromkeys(strict, 0)).items():
                made[0].add_word(term, (term, weight))
            made[0].make_automaton()
        return made[0]

    def judge(columns: list[list]) -> list[list]:
        ids, urls = columns
        out: list[tuple] = []
        for page, url in zip(ids, urls):
            host, path = split_url(url)
            rule = best_rule(host, path, table)
            n_strict, n_soft, weight = count_terms(url.translate(_LOWER), automaton()) if url else (0, 0, 0)
            verdict = rule[1] if rule else "block" if n_strict or n_soft >= min_soft and weight >= min_weight else "allow"
            out.append((page, host, path, rule and rule[0], verdict, n_strict, n_soft, weight))
        return [list(x) for x in zip(*out)]

    # the automaton is built in the worker: a closure must not carry it
    made.clear()
    return map_chunks(pages.selectExpr("cast(page_id as bigint) page_id", "url"), _RESULT, judge, rows=4096)
