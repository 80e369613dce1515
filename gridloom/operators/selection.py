"""Values of given ranks in a long column, without a sort and without a map of all values.

The ranks wanted are enclosed between splitters, which come from a sketch of bounded
size (one aggregation). A counting pass (one more) tells for certain where the ranks
stand among them: at a splitter, which settles a rank, or strictly between two. Only
rows between are looked at further, so each round leaves some thousandths of the rows.
When few are left, they come to the driver with their counts. The sketch is only a
proposal: the counts alone decide, so results are exact whatever it says.

Nulls are no values. NaN stands above all numbers, as in a sort.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..arrays import Array
from ..functions.core import real
from ..storage import stored
from .windows import running_totals

#: Distinct values that come to the driver at the end, the sketch's size, and the share of rows at which the rest is stored.
FEW, ACCURACY, STORE_AT = 10_000, 2000, 0.02
#: Rounds without a settled rank or a smaller rest, after which values are halved instead.
ROUNDS = 200


@dataclass
class _Gap:
    """Ranks that stand strictly between two values (None: open), with the rows below and in the gap."""

    low: float | None
    high: float | None
    below: int
    size: int
    ranks: list[int]

    def holds(self, v: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (v > self.low)
        if self.high is not None:
            out = out & (v < self.high)
        return out


def _splitters(rows: DataFrame, gaps: list[_Gap]) -> list[list[float]]:
    """Two values around each rank of every gap, by a sketch of the gap's rows."""
    v, asked = F.col("v"), []
    for gap in gaps:
        slack = 4 / ACCURACY
        at = sorted({min(1.0, max(0.0, (r - gap.below) / gap.size + d)) for r in gap.ranks for d in (-slack, 0, slack)})
        asked.append(F.percentile_approx(F.when(gap.holds(v), v), [float(x) for x in at], ACCURACY))
    return [sorted(set(x or [])) for x in rows.agg(*(c.alias(f"s{k}") for k, c in enumerate(asked))).first()]


def _counts(rows: DataFrame, gaps: list[_Gap], splitters: list[list[float]]) -> list[list[tuple[int, int]]]:
    """For each splitter the rows of its gap under it, and up to it."""
    v = F.col("v")
    wanted = [F.count_if(test & gap.holds(v)) for gap, points in zip(gaps, splitters) for x in points for test in (v < x, v <= x)]
    found = iter(rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(wanted))).first())
    return [[(next(found), next(found)) for _ in points] for points in splitters]


def _narrowed(gap: _Gap, points: list[float], counts: list[tuple[int, int]], done: dict[int, float]) -> list[_Gap]:
    """The gaps that are left of a gap; ranks that stand at a splitter are settled."""
    out: dict[int, _Gap] = {}
    for r in gap.ranks:
        at = r - gap.below
        k = bisect.bisect_right([upto for _, upto in counts], at)  # the first splitter that the rank does not pass
        if k < len(points) and counts[k][0] <= at:
            done[r] = points[k]
            continue
        low, under = (points[k - 1], counts[k - 1][1]) if k else (gap.low, 0)
        high, upto = (points[k], counts[k][0]) if k < len(points) else (gap.high, gap.size)
        out.setdefault(k, _Gap(low, high, gap.below + under, upto - under, [])).ranks.append(r)
    return list(out.values())


def select_ranks(df: DataFrame, value: str | Column, ranks: Sequence[int], few: int = FEW) -> dict[int, float]:
    """The values of 0-based ``ranks`` among the sorted values of a column; ranks outside are left out."""
    value = real(value)
    rows = df.select(value.alias("v")).filter("v is not null and not isnan(v)")
    n, nans = df.agg(F.count_if(value.isNotNull() & ~F.isnan(value)), F.count_if(F.isnan(value))).first()
    done = {r: math.nan for r in set(ranks) if n <= r < n + nans}
    gaps = [_Gap(None, None, 0, n, sorted(r for r in set(ranks) if 0 <= r < n))]
    total = n
    for _ in range(ROUNDS):
        gaps = [g for g in gaps if g.ranks]
        left = sum(g.size for g in gaps)
        if left <= few:
            break
        if left < STORE_AT * total:  # what is left is small: later rounds read only that
            rows, total = stored(rows.filter(_any(gaps)), "rest"), left
        points = _splitters(rows, gaps)
        gaps = [new for gap, p, c in zip(gaps, points, _counts(rows, gaps, points)) for new in _narrowed(gap, p, c, done)]
    else:
        raise RuntimeError("the ranks were not enclosed")
    if gaps:
        found = sorted(map(tuple, rows.filter(_any(gaps)).groupBy("v").agg(F.count("*")).collect()))
        for gap in gaps:
            mine = [(x, c) for x, c in found if (gap.low is None or x > gap.low) and (gap.high is None or x < gap.high)]
            ends, at = [], gap.below
            for _, c in mine:
                at += c
                ends.append(at)
            for r in gap.ranks:
                done[r] = mine[bisect.bisect_right(ends, r)][0]
    return done


def _any(gaps: list[_Gap]) -> Column:
    out = F.lit(False)
    for gap in gaps:
        out = out | gap.holds(F.col("v"))
    return out


def quantiles(df: DataFrame, value: str | Column, shares: Sequence[float], skip_nan: bool = False, few: int = FEW) -> list[float | None]:
    """Exact quantiles with linear interpolation; any NaN makes all of them NaN unless it is skipped; None of no values."""
    value = real(value)
    n, nans = df.agg(F.count(value), F.count_if(F.isnan(value))).first()
    if any(not 0 <= q <= 1 for q in shares):
        raise ValueError("shares go from 0 to 1")
    if nans and not skip_nan:
        return [math.nan] * len(shares)
    n -= nans
    if not n:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    found = select_ranks(df, value, [r for p in places for r in (math.floor(p), math.ceil(p))], few)
    out = []
    for p in places:
        low, high, t = found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)
        # from the nearer end, so that equal ends give themselves
        out.append(low if low == high else low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t))
    return out


def _rows(df: DataFrame, shares: Sequence[float], values: Sequence[float | None]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(zip(map(float, shares), values)), "q double, v double")


def quantile(df: DataFrame, value: str | Column, q: Sequence[float]) -> DataFrame:
    """A row q, v for each share."""
    return _rows(df, q, quantiles(df, value, q))


def percentile(df: DataFrame, value: str | Column, q: Sequence[float]) -> DataFrame:
    return _rows(df, q, quantiles(df, value, [x / 100 for x in q]))


def median(df: DataFrame, value: str | Column) -> float | None:
    return quantiles(df, value, [0.5])[0]


def nanquantile(df: DataFrame, value: str | Column, q: Sequence[float]) -> DataFrame:
    return _rows(df, q, quantiles(df, value, q, skip_nan=True))


def nanpercentile(df: DataFrame, value: str | Column, q: Sequence[float]) -> DataFrame:
    return _rows(df, q, quantiles(df, value, [x / 100 for x in q], skip_nan=True))


def nanmedian(df: DataFrame, value: str | Column) -> float | None:
    return quantiles(df, value, [0.5], skip_nan=True)[0]


def partitioned(a: Array, kth: int) -> DataFrame:
    """i0, v and ``was``: the kth value in its sorted place, smaller ones before it, others behind, each in their old order.

    Two running counts in the order of places; values are not sorted.
    """
    n = a.shape[0]
    kth = kth % n if -n <= kth < n else _outside(kth, n)
    value = real("v")
    pivot = select_ranks(a.df, value, [kth])[kth]
    nan = math.isnan(pivot)
    below = ~F.isnan(value) if nan else ~F.isnan(value) & (value < F.lit(pivot))
    equal = F.isnan(value) if nan else value == F.lit(pivot)
    flags = {"__low": below.cast("bigint"), "__same": equal.cast("bigint")}
    counted = running_totals(a.df.select("i0", "v"), ["i0"], flags)
    under, same = a.df.agg(F.sum(flags["__low"]), F.sum(flags["__same"])).first()
    # what is neither stands behind both
    place = F.when(below, F.col("__low") - 1).when(equal, F.lit(under) + F.col("__same") - 1).otherwise(F.lit(under + same) + F.col("i0") - F.col("__low") - F.col("__same"))
    return counted.select(place.cast("bigint").alias("i0"), "v", F.col("i0").alias("was"))


def _outside(kth: int, n: int) -> int:
    raise ValueError(f"kth={kth} is out of bounds for {n} values")
