"""Quality rules: line-first cleaning, in DataFrame functions only.

Every line of a text is judged by three families of rules:

* punctuation - it is mostly runs of symbols or exclamation marks, or it shouts;
* navigation - many of its tokens are separators (``|``, ``>``, ``/``), or it is a
  very short line without a closing mark that is repeated in the text;
* boilerplate - it contains a fixed phrase of web furniture.

Failing lines are removed. A document is then rejected if it lost more than
``max_lost`` of its non-blank characters, or if it fails the base rules (fewer
than ``min_words`` words, or too many words in repeated 3-word windows).

Most texts have nothing that a rule could fire on. Each rule that reads lines is
therefore guarded by a pattern over the whole text that any failing line would match,
and lines are judged one by one only in texts that match one. Repeated windows are
looked for by hashes, then counted by their words, whatever the length of the text.

Defined cases: a null text counts as empty; an empty text has no words and is
rejected by the base rules; repeated rows give repeated results; columns besides
the text are passed through by :func:`clean` under their own names, whatever these
are; no documents give no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE

#: Phrases of web furniture, as lower-case regular expressions.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
)
#: The symbols that the base counts.
SYMBOLS = "#*$%&|<>"

#: Characters of a very short line at most, and the marks that close a sentence or quotation.
SHORT, CLOSING = 30, tuple(".!?…:;,\"'”’»)]")

MIN_WORDS, MAX_REPEAT, MAX_LOST = 50, 0.5, 0.5
_SPACE, _SOLID = r"[ \t\n\x0B\f\r]+", r"[^ \t\n\x0B\f\r]"
#: What a text must match for any of its lines to fail: symbol runs, separators, capitals with no small letter between.
_GUARDS = (r"[!%#*$&=~_+-]{2}", r"[|>/·•-](?:[\s\u0085\u2028\u2029]|$)", r"[A-Z][^a-z]*[A-Z]")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    return F.array_remove(F.split(text, _SPACE, -1), "")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _says(text: Column) -> Column:
    """Whether a lower-cased text contains a phrase of web furniture."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in BOILERPLATE))


def is_short(line: Column) -> Column:
    """Whether a line is very short, not blank, and has no closing mark."""
    return (F.length(line) <= SHORT) & ~F.coalesce(F.substring(_trimmed(line), -1, 1).isin("", *CLOSING), F.lit(True))


def line_fails(line: Column) -> Column:
    """Whether a line is to be removed for itself (blank lines stay)."""
    tokens = F.greatest(F.regexp_count(line, F.lit(r"[^ \t\r\f]+")), F.lit(1))
    separators = F.regexp_count(line, F.lit(r"(?:^| )[|>/·•-](?: |$)"))
    runs = F.regexp_count(line, F.lit(r"[!%#*$&=~_+-]{2,}(?: |$)"))
    big, small = F.regexp_count(line, F.lit("[A-Z]")), F.regexp_count(line, F.lit("[a-z]"))
    return line.rlike(_SOLID) & ((runs * 10 >= tokens * 3) | ((big >= 20) & (big > 2 * small)) | (separators * 10 >= tokens * 3) | _says(F.lower(line)))


def _repeated(keys: Column, words: Column) -> Column:
    """Sorted places of the 3-word windows found twice or more.

    Windows whose hash is alone are alone. Where a hash is there twice, all windows of
    the text are sorted by hash and words, so equal ones are neighbours.
    """
    window = lambda k, i: F.struct(k.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))
    alike = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    runs = lambda rows: F.transform(rows, lambda x, i: F.when(alike(x, F.get(rows, i - 1)) | alike(x, F.get(rows, i + 1)), x["i"]))
    # an array of one keeps the sorted rows from being sorted again for each of them
    places = F.flatten(F.transform(F.array(F.sort_array(F.transform(keys, window))), runs))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.array().cast("array<int>")).otherwise(F.sort_array(F.array_compact(places)))


def _prefix(docs: DataFrame) -> str:
    """The start of helper names that no column of ``docs`` has."""
    prefix = "__gl_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def measure(docs: DataFrame, text_col: str = "text", prefix: str = "__gl_q_") -> DataFrame:
    """Add the struct ``{prefix}m`` of base counts and the cleaned text ``{prefix}clean`` to ``docs``."""
    name = {k: f"{prefix}{k}" for k in ("text", "words", "lines", "keys", "places", "short", "repeated", "suspect", "clean", "m")}
    c = {k: F.col(v) for k, v in name.items()}
    text, words, lines = c["text"], c["words"], c["lines"]
    df = docs.withColumn(name["text"], F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = df.withColumns({name["words"]: words_of(text), name["lines"]: F.split(text, "\n", -1)})
    keys = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    short = F.when(F.size(lines) > 1, F.sort_array(F.transform(F.filter(lines, is_short), _trimmed)))
    suspect = reduce(or_, (text.rlike(g) for g in _GUARDS)) | _says(F.lower(text))
    df = df.withColumns({name["keys"]: keys, name["short"]: short, name["suspect"]: suspect})
    again = F.array_distinct(F.filter(c["short"], lambda x, i: (i > 0) & (x == F.get(c["short"], i - 1))))
    df = df.withColumns({name["places"]: _repeated(c["keys"], words), name["repeated"]: F.when(F.size(name["short"]) > 1, again)})
    covered = F.aggregate(
        c["places"],
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"].cast("bigint"),
    )
    fine = F.when(c["suspect"], F.filter(lines, lambda x: ~line_fails(x))).otherwise(lines)
    menu = F.size(c["repeated"]) > 0
    fine = F.when(menu, F.filter(fine, lambda x: ~(is_short(x) & F.array_contains(c["repeated"], _trimmed(x))))).otherwise(fine)
    df = df.withColumn(name["clean"], F.when(c["suspect"] | menu, F.array_join(fine, "\n")).otherwise(text))
    word_chars = F.length(F.array_join(words, ""))
    good = F.filter(lines, lambda x: x.rlike(_SOLID))
    stats = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        word_chars.cast("bigint").alias("word_chars"),
        F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0).cast("bigint").alias("n_symbols"),
        F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.size(good) - F.size(F.array_distinct(good))).otherwise(0).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.when(c["suspect"] | menu, F.length(F.regexp_replace(c["clean"], _SPACE, ""))).otherwise(word_chars).cast("bigint").alias("clean_chars"),
    )
    return df.withColumn(name["m"], stats).drop(*(v for k, v in name.items() if k not in ("clean", "m")))


def verdicts(docs: DataFrame, text_col: str = "text", prefix: str = "__gl_q_", min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with ``{prefix}m``, ``{prefix}clean``, ``{prefix}failed`` and ``{prefix}kept``."""
    m = F.col(f"{prefix}m")
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > F.lit(int(100 * max_repeat)) * m["n_words"])
    lost = m["clean_chars"] < (1 - max_lost) * m["word_chars"]
    return measure(docs, text_col, prefix).withColumns({f"{prefix}failed": failed, f"{prefix}kept": ~failed & ~lost})


def clean(docs: DataFrame, text_col: str = "text", **params: float) -> DataFrame:
    """The documents that pass, with failing lines taken out of the text.

    A column ``n_chars`` is brought up to date where there is one.
    """
    prefix = _prefix(docs)
    # a column that is not deterministic keeps the filter above the verdict: pushed below, it
    # would repeat the whole computation inside every lambda
    fence = F.col(f"{prefix}fence") >= 0
    judged = verdicts(docs, text_col, prefix, **params).withColumn(f"{prefix}fence", F.monotonically_increasing_id())
    df = judged.filter(F.col(f"{prefix}kept") & fence).withColumn(text_col, F.col(f"{prefix}clean"))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_report(docs: DataFrame, **params: float) -> DataFrame:
    """A row of counts and the verdict for each document."""
    prefix = "__gl_q_"
    m, judged = F.col(f"{prefix}m"), verdicts(docs.select("doc_id", "text"), "text", prefix, **params)
    counts = (m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return judged.select("doc_id", *counts, F.col(f"{prefix}failed").alias("base_failed"), F.col(f"{prefix}kept").alias("kept"))
