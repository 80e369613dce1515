"""String functions on Columns: positions count from 0, ``start``/``end`` are honoured."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, functions as F

from .core import col


def add(x1: Any, x2: Any) -> Column:
    return F.concat(col(x1), col(x2))


def multiply(a: Any, i: int) -> Column:
    return F.repeat(col(a), max(0, i))


def upper(a: Any) -> Column:
    return F.upper(col(a))


def lower(a: Any) -> Column:
    return F.lower(col(a))


def _set(chars: str | None) -> str:
    return r"\s" if chars is None else "[" + "".join(re.escape(c) if c not in "^]\\-[&~" else "\\" + c for c in chars) + "]"


def lstrip(a: Any, chars: str | None = None) -> Column:
    return F.regexp_replace(col(a), f"^{_set(chars)}+", "")


def rstrip(a: Any, chars: str | None = None) -> Column:
    return F.regexp_replace(col(a), f"{_set(chars)}+\\z", "")


def strip(a: Any, chars: str | None = None) -> Column:
    return rstrip(lstrip(a, chars), chars)


def _span(a: Any, start: int | None, end: int | None) -> Column:
    """The part that Python's ``a[start:end]`` gives."""
    text = col(a)
    if not start and end is None:
        return text
    size = F.length(text)
    at = lambda i: F.greatest(F.lit(0), size + i) if i < 0 else F.least(F.lit(i), size)
    low = at(start or 0)
    high = size if end is None else at(end)
    return F.substring(text, low + 1, F.greatest(F.lit(0), high - low))


def _shift(a: Any, start: int | None) -> Column:
    if not start:
        return F.lit(0)
    return F.greatest(F.lit(0), F.length(col(a)) + start) if start < 0 else F.lit(start)


def find(a: Any, sub: str, start: int | None = None, end: int | None = None) -> Column:
    at = F.locate(sub, _span(a, start, end)) if sub else F.lit(1)
    return F.when(at == 0, F.lit(-1)).otherwise(at - 1 + _shift(a, start))


def rfind(a: Any, sub: str, start: int | None = None, end: int | None = None) -> Column:
    part = _span(a, start, end)
    at = F.locate(sub[::-1], F.reverse(part)) if sub else F.lit(1)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(part) - at + 1 - len(sub) + _shift(a, start))


def index(a: Any, sub: str, start: int | None = None, end: int | None = None) -> Column:
    at = find(a, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def rindex(a: Any, sub: str, start: int | None = None, end: int | None = None) -> Column:
    at = rfind(a, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def count(a: Any, sub: str, start: int | None = None, end: int | None = None) -> Column:
    """Places that do not overlap."""
    return F.regexp_count(_span(a, start, end), F.lit(re.escape(sub)))


def partition(a: Any, sep: str) -> Column:
    text, at = col(a), F.locate(sep, col(a))
    rest = F.substring(text, at + len(sep), F.length(text))
    return F.when(at == 0, F.array(text, F.lit(""), F.lit(""))).otherwise(F.array(F.substring(text, F.lit(1), at - 1), F.lit(sep), rest))


def rpartition(a: Any, sep: str) -> Column:
    text, at = col(a), rfind(a, sep)
    rest = F.substring(text, at + len(sep) + 1, F.length(text))
    return F.when(at < 0, F.array(F.lit(""), F.lit(""), text)).otherwise(F.array(F.substring(text, F.lit(1), at), F.lit(sep), rest))


def join(sep: str, a: Any) -> Column:
    """The separator between all characters."""
    return F.regexp_replace(col(a), r"(?s)(?<=.)(?=.)", re.sub(r"([\\$])", r"\\\1", sep))


def replace(a: Any, old: str, new: str, count: int | None = None) -> Column:
    if count is None:
        return F.replace(col(a), F.lit(old), F.lit(new))
    parts = F.split(col(a), re.escape(old), -1)
    head = F.array_join(F.slice(parts, 1, count + 1), new)
    tail = F.slice(parts, count + 2, F.greatest(F.size(parts), F.lit(1)))
    return F.when(F.size(parts) <= count + 1, head).otherwise(F.concat(head, F.lit(old), F.array_join(tail, old)))


def str_len(a: Any) -> Column:
    return F.char_length(col(a))


def startswith(a: Any, prefix: str, start: int | None = None, end: int | None = None) -> Column:
    return _span(a, start, end).startswith(prefix)


def endswith(a: Any, suffix: str, start: int | None = None, end: int | None = None) -> Column:
    return _span(a, start, end).endswith(suffix)


def isalpha(a: Any) -> Column:
    return col(a).rlike(r"\A\p{L}+\z")


def isdigit(a: Any) -> Column:
    return col(a).rlike(r"\A[0-9]+\z")


isdecimal = isdigit


def isnumeric(a: Any) -> Column:
    return col(a).rlike(r"\A\p{N}+\z")


def isalnum(a: Any) -> Column:
    return col(a).rlike(r"\A[\p{L}0-9]+\z")


def isspace(a: Any) -> Column:
    return col(a).rlike(r"\A\s+\z")


def isupper(a: Any) -> Column:
    return col(a).rlike(r"\p{Lu}") & ~col(a).rlike(r"\p{Ll}")


def islower(a: Any) -> Column:
    return col(a).rlike(r"\p{Ll}") & ~col(a).rlike(r"\p{Lu}")


def istitle(a: Any) -> Column:
    """Upper case starts every run of letters, lower case follows."""
    return col(a).rlike(r"\p{L}") & ~col(a).rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")


def _padded(a: Any, width: int, pad, fill: str) -> Column:
    text = col(a)
    return F.when(F.length(text) >= width, text).otherwise(pad(text, F.lit(width), F.lit(fill)))


def ljust(a: Any, width: int, fillchar: str = " ") -> Column:
    return _padded(a, width, F.rpad, fillchar)


def rjust(a: Any, width: int, fillchar: str = " ") -> Column:
    return _padded(a, width, F.lpad, fillchar)


def center(a: Any, width: int, fillchar: str = " ") -> Column:
    """Padding on both sides; an odd rest goes to the right."""
    text = col(a)
    left = F.floor((F.lit(width) - F.length(text)) / 2).cast("int")
    padded = F.rpad(F.concat(F.repeat(F.lit(fillchar), left), text), F.lit(width), F.lit(fillchar))
    return F.when(F.length(text) >= width, text).otherwise(padded)


def zfill(a: Any, width: int) -> Column:
    """Zeros after the sign."""
    text = col(a)
    sign = F.when(text.rlike(r"\A[+-]"), F.substring(text, 1, 1)).otherwise("")
    digits = F.when(text.rlike(r"\A[+-]"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    return F.when(F.length(text) >= width, text).otherwise(F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0"))))


def capitalize(a: Any) -> Column:
    text = col(a)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def _per_character(a: Any, f) -> Column:
    return F.array_join(F.transform(F.split(col(a), ""), f), "")


def title(a: Any) -> Column:
    """Every run of letters starts with upper case."""
    runs = F.regexp_extract_all(col(a), F.lit(r"(?s)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def swapcase(a: Any) -> Column:
    return _per_character(a, lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c)))


def expandtabs(a: Any, tabsize: int = 8) -> Column:
    """Tabs to the next stop, counted from the start of the line."""
    parts = F.split(col(a), "\t", -1)

    def step(done: Column, part: Column) -> Column:
        column = F.length(F.regexp_replace(done, "(?s)^.*[\n\r]", ""))
        return F.concat(done, F.repeat(F.lit(" "), F.lit(tabsize) - F.pmod(column, F.lit(max(1, tabsize)))) if tabsize > 0 else F.lit(""), part)

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.element_at(parts, 1), step)


def equal(x1: Any, x2: Any) -> Column:
    return col(x1) == col(x2)


def not_equal(x1: Any, x2: Any) -> Column:
    return col(x1) != col(x2)


def less(x1: Any, x2: Any) -> Column:
    return col(x1) < col(x2)


def less_equal(x1: Any, x2: Any) -> Column:
    return col(x1) <= col(x2)


def greater(x1: Any, x2: Any) -> Column:
    return col(x1) > col(x2)


def greater_equal(x1: Any, x2: Any) -> Column:
    return col(x1) >= col(x2)
