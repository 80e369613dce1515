"""Positions and running totals of tables that take many parts."""

import pytest
from pyspark.sql import functions as F

from gridloom.arrays import from_column, number_rows
from gridloom.operators import sorting, windows
from gridloom.arrays import Array

N = 3_000_000


@pytest.fixture(params=[("true", "true"), ("false", "true"), ("true", "false")], ids=["plain", "without AQE", "without reuse"])
def session(spark, request):
    names = ("spark.sql.adaptive.enabled", "spark.sql.exchange.reuse")
    was = [spark.conf.get(n) for n in names]
    for n, v in zip(names, request.param):
        spark.conf.set(n, v)
    yield spark
    for n, v in zip(names, was):
        spark.conf.set(n, v)


def table(spark):
    return spark.range(N).select(F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("a"), F.concat(F.lit("payload"), "id").alias("b"))


def in_order(df, key, at):
    """Whether ``at`` numbers the rows 0 .. N-1 in the order of ``key``: a sum over neighbours shows any swap."""
    found = df.agg(F.count("*"), F.count_distinct(at), F.min(at), F.max(at)).first()
    assert tuple(found) == (N, N, 0, N - 1)
    after = df.select((F.col(at) - 1).alias(at), F.col(key).alias("__next"))
    assert df.select(at, key).join(after, at).filter(F.col(key) > F.col("__next")).count() == 0


def test_number_rows(session):
    in_order(number_rows(table(session), ["key"], "at"), "key", "at")


def test_running_total(session):
    df = table(session)
    total = windows.running_total(df, ["key"], F.lit(1), "at", partitions=16).withColumn("at", F.col("at") - 1)
    in_order(total, "key", "at")


def test_positions(spark):
    df = table(spark)
    in_order(from_column(df, "key", ["key"]).df, "v", "i0")
    found = sorting.unique_all(df.withColumn("id", F.col("a")), "key", "id")
    in_order(found, "v", "inverse")


def test_long_lanes(spark):
    a = Array(spark.range(200_000).select(F.col("id").alias("i0"), F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5).alias("v")), (200_000,))
    got = windows.cumprod(a).df.groupBy((F.col("i0") % 2).alias("odd"), "v").count().collect()
    assert {(r.odd, r.v, r["count"]) for r in got} == {(0, 2.0, 100_000), (1, 1.0, 100_000)}
    phase = Array(spark.range(200_000).select(F.col("id").alias("i0"), F.pmod(F.col("id") * 1.0, F.lit(5.0)).alias("v")), (200_000,))
    flat = windows.unwrap(phase, period=5.0)
    assert flat.df.filter(F.abs(F.col("v") - F.col("i0")) > 1e-6).count() == 0
