"""As-of scans: the last known row before, and the first behind, every row of an order.

Points and queries are dealt together by range of the key and stored with the number of
their part. Inside a part the last point is carried forward (and, in the reverse order,
backward); what a part leaves to the next is one row, and these rows, one for each
part, are carried over in turn, so that empty parts and parts without points pass on
what came before them. No range join, and no task but those of the range.

Queries are looked up by their distinct values and joined back, so that a value which
many rows have is dealt once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import real
from ..storage import stored


def _prefix(*frames: DataFrame) -> str:
    """A prefix that no column has."""
    prefix = "asof_"
    while any(c.lower().startswith(prefix) for df in frames for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def carried(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """``rows`` with the columns ``before`` and ``after``: the last payload that isn't null up to each row, and the first from it on.

    Rows stand in the order of ``key``, then ``order``. ``payload`` is a struct column.
    """
    dealt = stored(rows.repartitionByRange(key, order).withColumn("part", F.spark_partition_id()), "dealt")
    up = Window.partitionBy("part").orderBy(key, order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("part").orderBy(F.desc(key), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({"before": F.last(payload, True).over(up), "after": F.last(payload, True).over(down)})
    place = F.struct(key, order)
    ends = dealt.groupBy("part").agg(F.max_by(payload, F.when(F.col(payload).isNotNull(), place)).alias("last"), F.min_by(payload, F.when(F.col(payload).isNotNull(), place)).alias("first"))
    # a row for each part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.last("last", True).over(earlier).alias("handed"), F.last("first", True).over(later).alias("ahead"))
    out = local.join(F.broadcast(ends), "part")
    return out.withColumns({"before": F.coalesce("before", "handed"), "after": F.coalesce("after", "ahead")}).drop("part", "handed", "ahead")


def asof(queries: DataFrame, on: str, points: DataFrame, key: str, payload: Sequence[str], right: bool = True) -> DataFrame:
    """The distinct values of ``on`` with ``before`` and ``after``, structs of ``key`` and the payload.

    ``before`` is the last point with key <= value (< value if not ``right``), ``after`` the first behind that.
    Points with a null or NaN key are left out, and so are queries with one. Of points of one key, the
    greatest payload is the last.
    """
    fine = lambda c: real(c).isNotNull() & ~F.isnan(real(c))
    known = points.filter(fine(key)).select(real(key).alias("x"), F.lit(1).alias("side"), F.struct(real(key).alias("x"), *payload).alias("p"))
    asked = queries.filter(fine(on)).select(real(on).alias("x")).distinct()
    side = F.lit(2 if right else 0).alias("side")
    both = known.unionByName(asked.select("x", side, F.lit(None).cast(dict(known.dtypes)["p"]).alias("p")))
    # of points of one key, the payload decides
    ordered = both.withColumn("side", F.struct("side", "p"))
    found = carried(ordered, "x", "side", "p")
    return found.filter("side.side <> 1").select("x", "before", "after")


def _joined(queries: DataFrame, on: str, found: DataFrame, value: Column, name: str) -> DataFrame:
    p = _prefix(queries, found)
    small = found.select(F.col("x").alias(f"{p}x"), value.alias(f"{p}v"))
    both = queries.join(small, real(on) == F.col(f"{p}x"), "left")
    return both.select(*(queries[c] for c in queries.columns if c != name), F.col(f"{p}v").alias(name))


def interp(queries: DataFrame, on: str, points: DataFrame, xp: str, fp: str, name: str = "interp", left: float | None = None, right: float | None = None) -> DataFrame:
    """``queries`` with ``name``: piecewise linear through a table of points, at any number of them.

    Below the first point it is ``left`` (the first point's value), above the last ``right``. Null
    for null queries, and where there are no points; NaN for NaN.
    """
    found = asof(queries, on, points, xp, [fp])
    a, b = F.col("before"), F.col("after")
    inside = a[fp].cast("double") + (F.col("x") - a["x"]) * ((b[fp] - a[fp]) / (b["x"] - a["x"]))
    low = F.lit(float(left)) if left is not None else b[fp].cast("double")
    high = F.lit(float(right)) if right is not None else a[fp].cast("double")
    value = F.when(a.isNull() & b.isNull(), None).when(a.isNull(), low).when(F.col("x") == a["x"], a[fp].cast("double")).when(b.isNull(), high).otherwise(inside)
    out = _joined(queries, on, found, value, name)
    return out.withColumn(name, F.when(F.isnan(real(on)), F.lit(float("nan"))).otherwise(F.col(name))) if on in out.columns else out


def asof_join(queries: DataFrame, on: str, points: DataFrame, key: str, payload: Sequence[str], right: bool = True) -> DataFrame:
    """``queries`` with the payload of the last point at or before each (null where there is none)."""
    found = asof(queries, on, points, key, payload, right)
    p = _prefix(queries, found, points)
    small = found.select(F.col("x").alias(f"{p}x"), F.col("before").alias(f"{p}p"))
    both = queries.join(small, real(on) == F.col(f"{p}x"), "left")
    return both.select(*(queries[c] for c in queries.columns), *(F.col(f"{p}p")[c].alias(c) for c in payload))


def digitize(queries: DataFrame, on: str, bins: DataFrame, edge: str, name: str = "bin", right: bool = False) -> DataFrame:
    """``queries`` with ``name``: the number of the bin among a table of rising edges (repeated edges count).

    The last edge at or below a value (below it, if ``right``) knows how many edges there are up to it.
    Null for null queries; NaN stands above all edges.
    """
    from ..arrays import number_rows

    rising = bins.select(real(edge).alias("x")).filter("x is not null and not isnan(x)")
    # edges of one value are numbered once, by how many are there up to the last of them
    numbered = number_rows(rising.withColumn("one", F.lit(1)), ["x"], "at").groupBy("x").agg((F.max("at") + 1).alias("n"))
    total = numbered.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    found = asof(queries, on, numbered, "x", ["n"], right=not right)
    out = _joined(queries, on, found, F.coalesce(F.col("before.n"), F.lit(0)), name)
    known = F.when(F.isnan(real(on)), F.lit(total)).when(real(on).isNotNull(), F.col(name))
    return out.withColumn(name, known.cast("bigint"))
