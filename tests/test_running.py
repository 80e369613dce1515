"""Running reductions on a stream with rows out of order, late rows, ties and nulls."""

import datetime as dt
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from gridloom.streaming.running import _added, running

DDL = "k string, t timestamp, id bigint, v double"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def stream(spark, tmp_path, batches, late):
    """All rows that a stream of files gives out, a file for each batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(source))
        query = (
            running(spark.readStream.schema(DDL).parquet(str(source)), "t", ["k"], "v", "id", late)
            .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )  # a restart for each batch: state comes back from the checkpoint
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def plain(df):
    return sorted((r.k or "", r.t, r.id, r.v, r["cumsum"], r["count"], r.cummax, r.cummin, r["diff"]) for r in df.collect())


def test_out_of_order(spark, tmp_path):
    batches = [
        [("a", at(5), 1, 5.0), ("a", at(1), 2, 1.0), ("b", at(3), 3, None), (None, at(4), 4, 2.0)],
        [("a", at(3), 5, 10.0), ("a", at(5), 0, -7.0), ("b", at(20), 6, 4.0), ("b", None, 7, 4.0)],
        [("a", at(2), 8, 99.0), ("a", at(30), 9, 3.0), ("b", at(20), 5, 8.0)],  # the first is late
        [("z", at(1000), 10, 0.0)],
    ]
    got = plain(stream(spark, tmp_path, batches, "10 seconds"))
    kept = spark.createDataFrame([r for b in batches[:3] for r in b if r[3] != 99.0], DDL)
    want = plain(running(kept, "t", ["k"], "v", "id"))
    assert [r[:3] for r in got] == [r[:3] for r in want] and got == want
    a = [r for r in got if r[0] == "a"]
    assert [(r[2], r[4], r[5], r[8]) for r in a] == [(2, 1.0, 1, None), (5, 11.0, 2, 9.0), (0, 4.0, 3, -17.0), (1, 9.0, 4, 12.0), (9, 12.0, 5, -2.0)]


def test_many_rows(spark, tmp_path):
    """Four batches of a thousand rows, shuffled within the lateness allowed, give what the table gives."""
    base = spark.range(4000).select((F.col("id") % 3).cast("string").alias("k"), (F.lit(1_700_000_000) + F.col("id") - F.col("id") * 7 % 20).cast("timestamp").alias("t"), "id", (F.col("id") * 37 % 101).cast("double").alias("v"))
    rows = [tuple(r) for r in base.orderBy("id").collect()]
    batches = [rows[k : k + 1000] for k in range(0, 4000, 1000)] + [[("end", dt.datetime(2030, 1, 1), 9999, 0.0)]]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = plain(stream(spark, tmp_path, batches, "60 seconds"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(got) == 4000 and got == plain(running(base, "t", ["k"], "v", "id"))


def test_many_keys(spark, tmp_path):
    """State is called for buckets, not for keys: timers stay within 256 for 3000 keys; totals go on over batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = spark.range(9000).selectExpr("IF(id % 3000 = 7, NULL, CAST(id % 3000 AS STRING)) AS k", "CAST(1700000000 + id DIV 3000 * 100 - id % 5 AS TIMESTAMP) AS t", "id", "IF(id % 4 = 0, NULL, id * 37 % 1001 / 7) AS v")
    end = spark.createDataFrame([("end", dt.datetime(2030, 1, 1), 9999, 0.0)], DDL)
    source, timers = str(tmp_path / "in"), []
    for part in (base.filter("id < 3000"), base.filter("id >= 3000"), end):
        part.coalesce(1).write.mode("append").parquet(source)
        query = (
            running(spark.readStream.schema(DDL).parquet(source), "t", ["k"], "v", "id", "10 seconds")
            .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        timers += [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["stateOperators"]]
    got = plain(spark.read.parquet(str(tmp_path / "out")))
    assert len(got) == 9000 and got == plain(running(base, "t", ["k"], "v", "id"))
    assert 0 < max(timers) <= 256


def test_kinds_of_keys(spark, tmp_path):
    """Keys come back as they were: whole numbers beyond doubles beside nulls, times, bytes, nulls of each kind."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl, keys = "a bigint, b timestamp, c binary, d double, e date, f boolean, g decimal(20,3), h struct<x: timestamp, y: array<string>>, t timestamp, id bigint, v double", list("abcdefgh")
    one = (2**53 + 1, dt.datetime(2024, 11, 3, 5, 30, 0, 123457), b"\xff\x00", -0.0, dt.date(1, 1, 1), True, Decimal("12345678901234567.125"), (dt.datetime(1850, 1, 1, 0, 0, 0, 7), ["", None, "ü\n"]))
    rows = [(*one, at(1), 1, 1.0), (*one[:3], 0.0, *one[4:], at(2), 2, 2.0), (2**53, *one[1:], at(2), 3, 4.0), (*[None] * 8, at(2), 4, 8.0), (*[None] * 8, at(1), 5, 16.0)]
    rows += [(*(None if x == k else y for x, y in enumerate(one)), at(3), 10 + k, 32.0) for k in range(8)]
    table = spark.createDataFrame(rows, ddl)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        query = (
            running(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "t", keys, "v", "id")
            .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out"))
        want = running(table, "t", keys, "v", "id")
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(str(r).replace("-0.0", "0.0") for r in want.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_totals_go_on():
    """Sums are added one after another, and what is known of a key goes on: no value yet, and a sum that is no number."""
    frame = lambda *rows: pd.DataFrame(rows, columns=["k", "gl_at", "id", "v"])
    inf = float("inf")
    out, totals = _added(frame(("a", 2, 1, 0.2), ("a", 1, 1, 0.1), ("b", 1, 1, inf), ("b", 2, 1, -inf), (None, 1, 1, None)), None, ["k"], "id", "v")
    assert out.query("k == 'a'")["cumsum"].tolist() == [0.1, 0.1 + 0.2]
    out, totals = _added(frame(("a", 3, 1, 0.3), ("b", 3, 1, 1.0), (None, 2, 1, 5.0)), totals, ["k"], "id", "v")
    assert out.query("k == 'a'")[["cumsum", "count", "cummax", "cummin"]].values.tolist() == [[0.1 + 0.2 + 0.3, 3, 0.3, 0.1]]
    assert out.query("k == 'b'")["cumsum"].isna().all() and out.query("k == 'b'")["count"].tolist() == [3]
    assert out[out["k"].isna()][["cumsum", "count"]].values.tolist() == [[5.0, 1]] and out[out["k"].isna()]["diff"].isna().all()
    assert len(totals) == 3
