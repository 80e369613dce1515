"""Language identification by Bayesian evidence fusion.

Four independent kinds of evidence are combined for each row:

* text: a naive Bayes likelihood of byte trigrams (hashed into ``BINS``), tempered so
  that long texts do not outweigh everything else;
* the declared markup language, and
* the suffix of the address (a country domain): each is believed as often as it agrees
  with the text's first choice over all rows, counted by aggregation and smoothed;
* a prior of the host, smoothed towards its domain and that towards all rows. Its
  counts are the text's first choices, summed by grouped aggregation.

The trigram model is fitted on at most ``MAX_FIT`` labelled documents, those with the
least hash of id, language and text (repeated rows count once); counts and priors cover
all rows. A row is rejected
if it has no text, if its text fits every language worse than ``floor`` a trigram, or
if the best posterior is under ``min_confidence``.

Defined cases: null text, declared language, address or host count as missing
evidence; without any evidence the language is null; ties go to the first language
in order of code; repeated rows each count.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_chunks, stored

BINS, MAX_FIT = 1 << 15, 1000
#: Trigrams to which a text's evidence is capped, and the smoothing of priors.
TEMPER, HOST_ALPHA, DOMAIN_ALPHA = 60.0, 5.0, 20.0
#: Prior counts (agreeing, all) of a declaration and of a suffix, and the limits of the probability that it is right.
DECLARED_COUNTS, SUFFIX_COUNTS, LIMITS = (9.0, 10.0), (8.0, 10.0), (0.5, 0.98)
MIN_CONFIDENCE, FLOOR = 0.5, -9.9
MAX_HOSTS = 200_000

#: Country suffixes and their main language.
SUFFIXES = {
    "ar": "es", "at": "de", "au": "en", "bo": "es", "br": "pt", "cl": "es", "co": "es", "cr": "es", "cu": "es", "cz": "cs", "de": "de", "dk": "da", "do": "es", "ec": "es",
    "es": "es", "fi": "fi", "fr": "fr", "gb": "en", "gr": "el", "gt": "es", "hn": "es", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "li": "de", "mx": "es",
    "ni": "es", "nl": "nl", "no": "no", "nz": "en", "pa": "es", "pe": "es", "pl": "pl", "pt": "pt", "py": "es", "ro": "ro", "ru": "ru", "se": "sv", "sv": "es", "tr": "tr",
    "ua": "uk", "uk": "en", "us": "en", "uy": "es", "ve": "es",
}
#: Labels below a country that are registries, as in co.uk.
REGISTRIES = frozenset("ac co com edu gob gov net ne nom or org".split())

_MARKS, _ENTITIES = re.compile(r"<(script|style)\b|<[^>]*>|&[a-z]+;", re.I), re.compile(r"&[a-z]+;", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")


def without_markup(text: str) -> str:
    """The text with a space for each tag, script, style and named character, in one pass over it."""
    last, at, out, endless = text.rfind(">") + 1, 0, [], set()
    found = _MARKS.search(text, 0, last)
    while found:
        out.append(text[at : found.start()])
        at, name = found.end(), (found[1] or "").lower()
        if name:
            end = None if name in endless else _ENDS[name].search(text, at)
            if end:
                at = end.end()
            else:  # never closed: only the tag goes
                endless.add(name)
                at = text.find(">", at) + 1
        found = _MARKS.search(text, at, last)
    out.append(_ENTITIES.sub(" ", text[at:]))
    return " ".join(out)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters of a text."""
    data = np.frombuffer(b" " + _LETTERS.sub(b" ", text.lower().encode("utf-8", "replace")) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    return (data[:-2] * 7919 + data[1:-1] * 263 + data[2:] * 31) & (BINS - 1)


def fit(labelled: DataFrame, max_fit: int = MAX_FIT) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bin) from columns text and lang."""
    keys = [c for c in ("doc_id", "lang", "text") if c in labelled.columns]
    hashed = labelled.filter("text is not null and lang is not null").select("text", "lang", F.xxhash64(*keys).alias("hash"))
    # the sample's largest hash comes from hashes alone, so no task gathers texts
    last = hashed.select("hash").distinct().orderBy("hash").limit(max_fit).agg(F.max("hash")).first()[0]
    # partial aggregation keeps one of equal rows in every task
    sample = hashed.filter(F.col("hash") <= F.lit(last)).groupBy("hash").agg(F.first("text").alias("text"), F.first("lang").alias("lang")).select("text", "lang")

    def count(columns: list[list]) -> list[list]:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(*columns):
            sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=BINS).astype(np.int32)
        return [list(sums), [s.tobytes() for s in sums.values()]]

    # a few arrays of bins for each language come to the driver
    total: dict[str, np.ndarray] = {}
    for lang, counts in map_chunks(sample, "lang string, counts binary", count).toLocalIterator():
        total[lang] = total.get(lang, np.zeros(BINS)) + np.frombuffer(bytes(counts), np.int32)
    langs = sorted(total)
    if not langs:
        return [], np.zeros((0, BINS), np.float32)
    counts = np.stack([total[x] for x in langs]) + 0.05
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def domain_of(host: str) -> str:
    """The last two labels, or three under a registry of a country."""
    labels = host.split(".")
    return ".".join(labels[-3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in REGISTRIES else -2 :])


def score_text(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool = False) -> DataFrame:
    """id, host, domain, declared, suffix, the mean log likelihoods and the number of trigrams.

    ``rows`` has the columns id, text, declared, address and host.
    """
    langs, table = model
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(table.T.copy())  # bins x languages: a fixed number of bins

    def score(columns: list[list]) -> list[list]:
        ids, texts, declared, address, hosts = columns
        means, sizes = [], []
        for text in texts:
            found = trigrams(without_markup(text) if markup and text else text or "")
            letters = len(found)
            means.append(sent.value[found].sum(axis=0, dtype=np.float64) / letters if letters > 2 else np.zeros(len(langs)))
            sizes.append(letters if letters > 2 else 0)
        domains = [domain_of(h) if h else None for h in hosts]
        suffix = [SUFFIXES.get((a or "").rpartition(".")[2].lower()) for a in address]
        declared = [(d or "").strip().lower().replace("_", "-").split("-")[0] or None for d in declared]
        return [ids, [h or None for h in hosts], domains, declared, suffix, [m.tolist() for m in means], sizes]

    ddl = "id bigint, host string, domain string, declared string, suffix string, means array<double>, n bigint"
    return map_chunks(rows.select("id", "text", "declared", "address", "host"), ddl, score)


def _choice(langs: list[str], scores: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in langs)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def host_priors(scored: DataFrame, langs: list[str]) -> DataFrame:
    """host and its smoothed prior: log probabilities in order of ``langs``."""
    first = scored.filter("n > 0 and host is not null").select("host", "domain", _choice(langs, F.col("means")).alias("choice"))
    counts = [F.count_if(F.col("choice") == x).alias(f"c{k}") for k, x in enumerate(langs)]
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(len(langs))]
    hosts = first.groupBy("host", "domain").agg(*counts)
    domains = hosts.groupBy("domain").agg(*sums)
    everything = domains.agg(*sums).first()
    total = sum(x or 0 for x in everything)
    base = [((x or 0) + 1) / (total + len(langs)) for x in everything]
    smooth = lambda k, n, alpha, up: (F.col(f"c{k}") + alpha * up) / (n + alpha)
    n = sum((F.col(f"c{k}") for k in range(len(langs))), F.lit(0))
    domains = domains.select("domain", *(smooth(k, n, F.lit(DOMAIN_ALPHA), F.lit(base[k])).alias(f"d{k}") for k in range(len(langs))))
    joined = hosts.join(domains, "domain")
    return joined.select("host", F.array(*(F.log(smooth(k, n, F.lit(HOST_ALPHA), F.col(f"d{k}"))) for k in range(len(langs)))).alias("prior"))


def agreement(scored: DataFrame, langs: list[str]) -> tuple[float, float]:
    """How often the declared language, and that of the suffix, is the text's first choice: smoothed shares over all rows."""
    first, found = _choice(langs, F.col("means")), []
    both = [f(F.col(c).isin(langs) & (F.col("n") > 0)) for c in ("declared", "suffix") for f in (lambda x, c=c: F.count_if(x & (F.col(c) == first)), F.count_if)]
    counts = scored.agg(*(x.alias(f"c{k}") for k, x in enumerate(both))).first()
    for k, (agree, total) in enumerate((DECLARED_COUNTS, SUFFIX_COUNTS)):
        found.append(min(LIMITS[1], max(LIMITS[0], (counts[2 * k] + agree) / (counts[2 * k + 1] + total))))
    return tuple(found)


def identify(
    rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool = False, min_confidence: float = MIN_CONFIDENCE, floor: float = FLOOR, max_hosts: int = MAX_HOSTS
) -> DataFrame:
    """id, host, declared, suffix, lang, confidence and kept for every row."""
    langs = model[0]
    nothing = F.lit(None).cast("string")
    if not langs:
        return rows.select("id", "host", "declared", nothing.alias("suffix"), nothing.alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    scored = stored(score_text(rows, model, markup), "language-scores")
    priors = stored(host_priors(scored, langs), "language-priors")
    p_declared, p_suffix = agreement(scored, langs)
    if priors.limit(max_hosts + 1).count() <= max_hosts:
        joined = scored.join(F.broadcast(priors), "host", "left")
    else:  # more hosts than may be broadcast: join by shuffling, salted against hot hosts
        salts = 16
        spread = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    other = max(1, len(langs) - 1)
    named = lambda c, lang, p: F.when(F.col(c).isin(langs), F.when(F.col(c) == lang, math.log(p)).otherwise(math.log((1 - p) / other))).otherwise(0.0)
    weight = F.least(F.col("n"), F.lit(TEMPER))
    sums = F.array(
        *(
            weight * F.get("means", F.lit(k)) + F.coalesce(F.get("prior", F.lit(k)), F.lit(-math.log(len(langs)))) + named("declared", x, p_declared) + named("suffix", x, p_suffix)
            for k, x in enumerate(langs)
        )
    )
    df = joined.withColumn("sums", sums).withColumn("best", F.array_max("sums"))
    confidence = 1 / F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    df = df.withColumn("confidence", F.round(confidence, 6))
    missing = (F.col("n") == 0) & F.col("declared").isNull() & F.col("suffix").isNull() & F.col("prior").isNull()
    kept = (F.col("n") > 0) & (F.array_max("means") >= floor) & (F.col("confidence") >= min_confidence)
    return df.select("id", "host", "declared", "suffix", F.when(~missing, _choice(langs, F.col("sums"))).alias("lang"), "confidence", kept.alias("kept"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows for :func:`identify` from page_id, url and html."""
    host = F.lower(F.regexp_extract("url", "(?s)://([^/?#:]*)", 1))
    lang = F.nullif(F.regexp_extract("html", "(?is)<html[^>]*\\slang\\s*=\\s*[\"']?([a-z]{2,3})", 1), F.lit(""))
    return pages.select(F.col("page_id").cast("bigint").alias("id"), F.col("html").alias("text"), lang.alias("declared"), host.alias("address"), host.alias("host"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows for :func:`identify` from doc_id, text and source; ``lang`` is what the model is fitted on, so it is no evidence."""
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("address"), F.col("source").alias("host"))
