"""Types: names, kinds and promotion. Metadata only; nothing here runs a job."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

import numpy as np
from ..arrays import Array

#: Type names by kind, with their widths in bytes.
KINDS = {
    "bool": {"bool": 1},
    "signed integer": {"int8": 1, "int16": 2, "int32": 4, "int64": 8},
    "unsigned integer": {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8},
    "real floating": {"float16": 2, "float32": 4, "float64": 8},
    "complex floating": {"complex64": 8, "complex128": 16},
}
#: The Spark type that holds each type.
SPARK = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double", "complex64": "struct<re:double,im:double>", "complex128": "struct<re:double,im:double>", "str": "string",
}
_WIDTH = {n: w for names in KINDS.values() for n, w in names.items()}
_KIND = {n: k for k, names in KINDS.items() for n in names}
_ORDER = list(KINDS)


def _width(name: str) -> int:
    if name not in _WIDTH:
        raise TypeError(f"no numeric type {name}")
    return _WIDTH[name]


def promote_types(a: str, b: str) -> str:
    """The least type that holds both."""
    if a == b:
        return a
    if _WIDTH.get(a) is None or _WIDTH.get(b) is None:
        raise TypeError(f"no common type of {a} and {b}")
    low, high = sorted((a, b), key=lambda n: (_ORDER.index(_KIND[n]), _WIDTH[n]))
    kinds = _KIND[low], _KIND[high]
    if kinds[0] == kinds[1] or low == "bool":
        return high
    if kinds[1] == "complex floating":
        wide = low == "float64" or (kinds[0].endswith("integer") and _width(low) >= 4)
        return "complex128" if wide or high == "complex128" else "complex64"
    if kinds[1] == "real floating":
        need = {1: 2, 2: 4}.get(_width(low), 8)
        return {2: "float16", 4: "float32", 8: "float64"}[max(need, _width(high))]
    # signed with unsigned: a signed type wider than the unsigned one
    need = max(_width(low), 2 * _width(high))
    return f"int{8 * need}" if need <= 8 else "float64"


def result_type(*types: str) -> str:
    out = types[0]
    for t in types[1:]:
        out = promote_types(out, t)
    return out


def can_cast(source: str, target: str, casting: str = "safe") -> bool:
    if casting == "unsafe" or source == target:
        return True
    if casting in ("no", "equiv"):
        return False
    if casting == "safe":
        return promote_types(source, target) == target
    return _ORDER.index(_KIND[source]) <= _ORDER.index(_KIND[target]) or {_KIND[source], _KIND[target]} == {"signed integer", "unsigned integer"}


def issubdtype(name: str, category: str) -> bool:
    """Whether a type is in a category such as ``integer``, ``floating``, ``number``."""
    groups = {
        "generic": _ORDER, "number": _ORDER[1:], "integer": _ORDER[1:3], "signedinteger": _ORDER[1:2], "unsignedinteger": _ORDER[2:3],
        "inexact": _ORDER[3:], "floating": _ORDER[3:4], "complexfloating": _ORDER[4:], "bool": _ORDER[:1],
    }
    return _KIND.get(name) in groups[category] if category in groups else name == category


def isdtype(name: str, kind: str) -> bool:
    groups = {"integral": _ORDER[1:3], "numeric": _ORDER[1:]}
    return name == kind or _KIND.get(name) in groups.get(kind, [kind])


def common_type(*types: str) -> str:
    """The least inexact type that holds all."""
    return result_type(*("float64" if _KIND[t].endswith("integer") or t == "bool" else t for t in types))


def spark_type(name: str) -> str:
    return SPARK[name]


def astype(a: Array, name: str) -> Array:
    return a.map(lambda v: v.cast(SPARK[name]))


def ndim(a: Array) -> int:
    return a.ndim


def shape(a: Array) -> tuple[int, ...]:
    return a.shape


def size(a: Array) -> int:
    return a.size


def shares_memory(a: Array, b: Array) -> bool:
    """Frames are immutable: only one plan read twice is shared."""
    return a.df.sameSemantics(b.df)


may_share_memory = shares_memory


def no_op(a: Array, *_: Any) -> Array:
    """Physical layout has no meaning for a frame."""
    return a


copy = ascontiguousarray = asfortranarray = require = no_op


def schema_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


class iinfo:  # noqa: N801
    """The range of an integer type."""

    def __init__(self, name: str) -> None:
        found = np.iinfo(name)
        self.dtype, self.bits, self.min, self.max = name, found.bits, int(found.min), int(found.max)

    def __repr__(self) -> str:
        return f"iinfo(min={self.min}, max={self.max}, dtype={self.dtype})"


class finfo:  # noqa: N801
    """The limits of a floating type."""

    def __init__(self, name: str) -> None:
        found = np.finfo(name)
        self.dtype, self.bits, self.eps, self.min, self.max, self.tiny = name, found.bits, float(found.eps), float(found.min), float(found.max), float(found.tiny)

    def __repr__(self) -> str:
        return f"finfo(eps={self.eps}, min={self.min}, max={self.max}, dtype={self.dtype})"
