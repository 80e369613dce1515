"""Running reductions on a stream: totals, counts, extremes and differences in the order of event time.

A row waits in keyed state until the watermark has passed its time; then no earlier row
can come any more, and it is given out with the totals of its key up to it. State holds
each key's totals and the rows that still wait, so its size follows the keys and the
lateness that is allowed, not the stream. Rows later than that are dropped, as everywhere
in the engine that runs this.

A call into state costs far more than a row, so state is kept for buckets of keys, not for
keys: calls follow the buckets, however many keys there are. Rows wait in packed blocks,
and a timer for the earliest of them wakes the bucket up, which reads its rows and totals
and writes back what still waits. A task holds a bucket at a time.

Rows of one time are taken in the order of ``order``. A null value leaves totals as
they are, and so does NaN on a stream; a row without a time is dropped. One key's rows
pass one task a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What is added to each row.
ADDED = ("cumsum", "count", "cummax", "cummin", "diff")

#: Times in microseconds, which no time zone of a session changes (names of columns in state do not begin with underscores).
_AT = "gl_at"
_BUCKET = "gl_bucket"
#: A key's totals: sum, count, largest, smallest and last value.
_TOTALS = ("gl_sum", "gl_n", "gl_most", "gl_least", "gl_last")
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


class _Running(StatefulProcessor):
    def __init__(self, keys: Sequence[str], order: str, value: str) -> None:
        self.keys, self.order, self.value = list(keys), order, value
        texts, whole, real = [(k, pa.string()) for k in keys], pa.int64(), pa.float64()
        self.row = pa.schema([*texts, (_AT, whole), (order, whole), (value, real)])
        self.total = pa.schema([*texts, *((x, whole if x == "gl_n" else real) for x in _TOTALS)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.woken = handle, set()
        self.waiting = handle.getListState("waiting", "first bigint, rows binary")
        self.totals = handle.getValueState("totals", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        firsts = []
        for part in rows:
            if part[self.order].isna().any():
                raise ValueError(f"{self.order} is null")
            firsts.append(self._wait(part))
        if firsts:
            self._wake(min(firsts))
        return iter(())

    def _wait(self, part: pd.DataFrame) -> int:
        first = int(part[_AT].min())
        self.waiting.appendValue((first, _packed(part, self.row)))
        return first

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if tuple(key) in self.woken:  # by another of its timers
            return
        self.woken.add(tuple(key))
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for first, block in self.waiting.get():
            if first > passed:
                later.append((first, bytes(block)))
                continue
            rows = _unpacked(block)
            due = rows[_AT] <= passed
            ready.append(rows[due])
            if not due.all():
                rows = rows[~due]
                later.append((int(rows[_AT].min()), _packed(rows, self.row)))
        if not ready:
            return
        if later:
            self.waiting.put(later)
            self._wake(min(first for first, _ in later))
        else:
            self.waiting.clear()
        out, totals = _added(pd.concat(ready, ignore_index=True), _unpacked(self.totals.get()[0]) if self.totals.exists() else None, self.keys, self.order, self.value)
        self.totals.update((_packed(totals, self.total),))
        yield out

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(rows, schema, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(block))).read_all().to_pandas()


def _added(ready: pd.DataFrame, before: pd.DataFrame | None, keys: list[str], order: str, value: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows that are due with the :data:`ADDED` columns, and the totals after them of all keys seen."""
    known = 0 if before is None else len(before)
    rows = pd.concat([before[keys], ready], ignore_index=True) if known else ready
    code = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    fresh = np.arange(len(rows)) >= known  # a key's totals so far stand before its rows
    at, among = (np.concatenate([np.zeros(known, "int64"), ready[x].to_numpy("int64")]) for x in (_AT, order))
    turn = np.lexsort((among, at, fresh, code))
    code, fresh = code[turn], fresh[turn]

    v = ready[value].to_numpy("float64")
    there, ever = ~np.isnan(v), before["gl_n"].to_numpy() > 0 if known else None

    def column(total: str, of_rows: np.ndarray, if_none: float) -> np.ndarray:
        found = np.where(there, of_rows, if_none)
        return (np.concatenate([np.where(ever, before[total].to_numpy(), if_none), found]) if known else found)[turn]

    end = np.flatnonzero(np.append(code[1:] != code[:-1], True)) + 1
    total = column("gl_sum", v, -0.0)
    with np.errstate(invalid="ignore"):
        for a, b in zip([0, *end[:-1]], end):
            np.cumsum(total[a:b], out=total[a:b])  # one after another, as SQL adds
    n = pd.Series(column("gl_n", np.int64(1), 0)).groupby(code).cumsum()
    none = n.to_numpy() == 0
    total = pd.Series(total).mask(none)
    most = pd.Series(column("gl_most", v, -np.inf)).groupby(code).cummax().mask(none)
    least = pd.Series(column("gl_least", v, np.inf)).groupby(code).cummin().mask(none)
    own = pd.Series(column("gl_last", v, np.nan))
    last = own.groupby(code).ffill()
    step = own - last.groupby(code).shift()

    rows = rows.take(turn).reset_index(drop=True)
    out = rows.assign(**dict(zip(ADDED, (total, n, most, least, step))))[fresh]
    totals = rows[keys].assign(**dict(zip(_TOTALS, (total, n, most, least, last)))).iloc[end - 1]
    return out[[*keys, _AT, order, value, *ADDED]].astype({_AT: "int64", order: "int64"}), totals


def _text(key: str, kind: str) -> Column:
    """A key as text, from which :func:`_key` makes the same key again."""
    k = F.col(key)
    if kind == "timestamp":
        k = F.unix_micros(k)  # which no time zone of a session changes
    elif kind == "binary":
        k = F.hex(k)
    elif kind in ("float", "double"):
        k = k + F.lit(0).cast(kind)  # -0.0 is 0.0
    elif kind.startswith(("array", "struct")):
        k = F.to_json(k, _JSON)
    return k.cast("string").alias(key)


def _key(key: str, kind: str) -> Column:
    k = F.col(key)
    if kind == "timestamp":
        k = F.timestamp_micros(k.cast("bigint"))
    elif kind == "binary":
        k = F.unhex(k)
    elif kind.startswith(("array", "struct")):
        k = F.from_json(k, kind, _JSON)
    return k.cast(kind).alias(key)


def running(rows: DataFrame, time: str, keys: Sequence[str], value: str, order: str, late: str = "0 seconds", buckets: int = 256) -> DataFrame:
    """keys, time, order, value and the :data:`ADDED` columns of each row, on a stream or a table.

    ``order`` is a whole number that tells rows of one time apart. A stream needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``); ``buckets`` should be so many
    that a task can hold the waiting rows of one, and stays as it is over the life of a checkpoint.
    """
    kinds, taken = dict(rows.dtypes), [*keys, time, order, value]
    clash = {x.lower() for x in taken} & {*ADDED, _AT, _BUCKET, *_TOTALS}
    if clash or len({x.lower() for x in taken}) < len(taken):
        raise ValueError(f"columns named twice, or as a result is: {sorted(clash) or taken}")
    slim = rows.filter(F.col(time).isNotNull()).select(*keys, time, F.col(order).cast("bigint").alias(order), F.col(value).cast("double").alias(value))
    if rows.isStreaming:
        ddl = ", ".join([*(f"`{k}` string" for k in keys), f"{_AT} bigint, `{order}` bigint, `{value}` double, cumsum double, `count` bigint, cummax double, cummin double, diff double"])
        texts = slim.select(*(_text(k, kinds[k]) for k in keys), time, order, value, F.unix_micros(time).alias(_AT)).withWatermark(time, late)
        grouped = texts.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy(_BUCKET)
        out = grouped.transformWithStateInPandas(statefulProcessor=_Running(keys, order, value), outputStructType=ddl, outputMode="Append", timeMode="EventTime")
        return out.select(*(_key(k, kinds[k]) for k in keys), F.timestamp_micros(_AT).alias(time), order, value, *ADDED)
    past = Window.partitionBy(*keys).orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(value, ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, -1))
    v = F.col(value)
    return slim.select("*", F.sum(v).over(past).alias("cumsum"), F.count(v).over(past).alias("count"), F.max(v).over(past).alias("cummax"), F.min(v).over(past).alias("cummin"), (v - before).alias("diff"))
