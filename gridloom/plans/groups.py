"""Queries of reductions, sets, bins and order over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bits
from ..operators import linalg, numeric, reductions as r, sorting, windows
from ..operators.random import Generator
from ..streaming import aggregates
from .catalog import number, query, read, rounded

_NAN = "CAST('NaN' AS DOUBLE)"


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) + 0.0 AS sum_qty, round(avg(l_extendedprice), 6) + 0.0 AS mean_price,
round(var_pop(l_discount), 6) + 0.0 AS var_discount, max(l_tax) AS max_tax, min(l_tax) AS min_tax, count(*) AS n
FROM lineitem GROUP BY ALL""")
def reduce_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        number(r.sum("l_quantity")).alias("sum_qty"),
        number(r.mean("l_extendedprice")).alias("mean_price"),
        number(r.var("l_discount")).alias("var_discount"),
        r.max("l_tax").alias("max_tax"),
        r.min("l_tax").alias("min_tax"),
        F.count("*").alias("n"),
    )


def _one(name: str, column, sql: str) -> None:
    """A reduction of orders by priority."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = read(spark, sf_dir, "orders").select(
            "o_orderpriority", F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("x"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000).alias("w")
        )
        return base.groupBy("o_orderpriority").agg(column().alias("value"))

    run.__name__ = name
    query(f"""SELECT o_orderpriority, {sql} AS value FROM (SELECT o_orderpriority, o_orderkey AS k, o_totalprice / 1000 AS x,
CASE WHEN o_orderkey % 3 = 0 THEN {_NAN} ELSE o_totalprice / 1000 END AS w FROM orders) GROUP BY o_orderpriority""")(run)


_R = lambda s: f"round({s}, 6) + 0.0"
_OK = "FILTER (WHERE NOT isnan(w))"
for _name, _column, _sql in (
    ("sum", lambda: number(r.sum("x")), _R("sum(x)")),
    ("mean", lambda: number(r.mean("x")), _R("avg(x)")),
    ("var", lambda: number(r.var("x")), _R("var_pop(x)")),
    ("std", lambda: number(r.std("x")), _R("stddev_pop(x)")),
    ("max", lambda: number(r.max("w")), _R(f"max(w) {_OK}")),
    ("min", lambda: number(r.min("w")), _R(f"min(w) {_OK}")),
    ("ptp", lambda: number(r.ptp("x")), _R("max(x) - min(x)")),
    ("prod", lambda: number(r.prod(1 + F.col("x") / 1e6)), _R("exp(sum(ln(1 + x / 1e6)))")),
    ("argmax", lambda: r.argmax("x", "k"), "(array_agg(k ORDER BY x DESC, k))[1]"),
    ("argmin", lambda: r.argmin("x", "k"), "(array_agg(k ORDER BY x, k))[1]"),
    ("nanargmax", lambda: r.nanargmax("w", "k"), f"(array_agg(k ORDER BY w DESC, k) {_OK})[1]"),
    ("nanargmin", lambda: r.nanargmin("w", "k"), f"(array_agg(k ORDER BY w, k) {_OK})[1]"),
    ("nansum", lambda: number(r.nansum("w")), _R(f"sum(w) {_OK}")),
    ("nanprod", lambda: number(r.nanprod(1 + F.col("w") / 1e6)), _R(f"exp(sum(ln(1 + w / 1e6)) {_OK})")),
    ("nanmean", lambda: number(r.nanmean("w")), _R(f"avg(w) {_OK}")),
    ("nanvar", lambda: number(r.nanvar("w")), _R(f"var_pop(w) {_OK}")),
    ("nanstd", lambda: number(r.nanstd("w")), _R(f"stddev_pop(w) {_OK}")),
    ("nanmax", lambda: number(r.nanmax("w")), _R(f"max(w) {_OK}")),
    ("nanmin", lambda: number(r.nanmin("w")), _R(f"min(w) {_OK}")),
    ("nanmedian", lambda: number(r.nanmedian("w")), _R(f"quantile_cont(w, 0.5) {_OK}")),
    ("nanpercentile", lambda: number(r.nanpercentile("w", 30)), _R(f"quantile_cont(w, 0.3) {_OK}")),
    ("nanquantile", lambda: number(r.nanquantile("w", 0.9)), _R(f"quantile_cont(w, 0.9) {_OK}")),
    ("median", lambda: number(r.median("x")), _R("quantile_cont(x, 0.5)")),
    ("percentile", lambda: number(r.percentile("x", 25)), _R("quantile_cont(x, 0.25)")),
    # five decimals, interpolated by hundredths: seven decimals, so ties at six
    ("quantile", lambda: rounded(r.quantile("x", 0.95), 8) + F.lit(0.0), "round(quantile_cont(x, 0.95), 8) + 0.0"),
    ("all", lambda: r.all("x"), "bool_and(x <> 0)"),
    ("any", lambda: r.any("x"), "bool_or(x <> 0)"),
    ("count_nonzero", lambda: r.count_nonzero(F.col("k") % 2), "count(*) FILTER (WHERE k % 2 <> 0)"),
    ("average", lambda: number(r.average("x", F.col("k") % 5)), _R("sum(x * (k % 5)) / sum(k % 5)")),
):
    _one(_name, _column, _sql)


@query("""WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS a, covar_samp(l_quantity, l_extendedprice) AS b, covar_samp(l_extendedprice, l_extendedprice) AS c FROM lineitem)
SELECT i0, i1, round(v, 2) + 0.0 AS v FROM (SELECT 0 AS i0, 0 AS i1, a AS v FROM c UNION ALL SELECT 0, 1, b FROM c UNION ALL SELECT 1, 0, b FROM c UNION ALL SELECT 1, 1, c FROM c)""")
def cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.cov(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumn("v", F.round("v", 2) + F.lit(0.0))


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS b FROM lineitem)
SELECT i0, i1, round(v, 6) + 0.0 AS v FROM (SELECT 0 AS i0, 0 AS i1, 1.0::DOUBLE AS v UNION ALL SELECT 0, 1, b FROM c UNION ALL SELECT 1, 0, b FROM c UNION ALL SELECT 1, 1, 1.0)""")
def corrcoef(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.corrcoef(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumn("v", number(F.col("v")))


@query("""SELECT least(CAST(floor((value - 0) * 20 / 500) AS BIGINT), 19) AS b0, count(*) AS count FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL
UNION ALL SELECT g.b, 0 FROM range(20) g(b) WHERE g.b NOT IN (SELECT least(CAST(floor(value * 20 / 500) AS BIGINT), 19) FROM events WHERE value BETWEEN 0 AND 500)""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.histogram(read(spark, sf_dir, "events"), "value", 20, (0.0, 500.0)).select("b0", "count")


@query("SELECT CAST(b AS BIGINT) AS i0, round(lo + b * (hi - lo) / 10, 6) + 0.0 AS v FROM (SELECT min(value) AS lo, max(value) AS hi FROM events), range(11) g(b)")
def histogram_bin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.histogram_bin_edges(read(spark, sf_dir, "events"), "value").withColumn("v", number(F.col("v")))


@query("""WITH h AS (SELECT least(CAST(floor(l_quantity * 5 / 50) AS BIGINT), 4) AS b0, least(CAST(floor(l_discount * 4 / 0.1) AS BIGINT), 3) AS b1 FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1)
SELECT CAST(x.b AS BIGINT) AS b0, CAST(y.b AS BIGINT) AS b1, count(h.b0) AS count FROM range(5) x(b) CROSS JOIN range(4) y(b) LEFT JOIN h ON h.b0 = x.b AND h.b1 = y.b GROUP BY ALL""")
def histogram2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.histogram2d(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", [5, 4], [(0.0, 50.0), (0.0, 0.1)])


@query("SELECT CAST(g.b AS BIGINT) AS i0, count(p_size) AS v FROM range(60) g(b) LEFT JOIN part ON p_size = g.b GROUP BY ALL")
def bincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.bincount(read(spark, sf_dir, "part"), "p_size", 60)


@query("SELECT DISTINCT p_brand AS v FROM part")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.unique(read(spark, sf_dir, "part"), "p_brand")


@query("SELECT p_brand AS v, count(*) AS count FROM part GROUP BY p_brand")
def unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.unique_counts(read(spark, sf_dir, "part"), "p_brand")


@query("SELECT p_partkey, p_brand AS v, dense_rank() OVER (ORDER BY p_brand) - 1 AS inverse FROM part")
def unique_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.unique_inverse(read(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("SELECT p_brand AS v, min(p_partkey) AS first_index, count(*) AS count, row_number() OVER (ORDER BY p_brand) - 1 AS inverse FROM part GROUP BY p_brand")
def unique_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.unique_all(read(spark, sf_dir, "part"), "p_brand", "p_partkey")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")


@query("SELECT c_custkey AS v FROM customer UNION SELECT o_custkey FROM orders")
def union1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return sorting.union1d(a, b, "c_custkey", "o_custkey")


@query("SELECT c_custkey AS v FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return sorting.intersect1d(a, b, "c_custkey", "o_custkey")


@query("SELECT c_custkey AS v FROM customer EXCEPT SELECT o_custkey FROM orders")
def setdiff1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return sorting.setdiff1d(a, b, "c_custkey", "o_custkey")


@query("(SELECT c_custkey AS v FROM customer EXCEPT SELECT o_custkey * 2 FROM orders) UNION (SELECT o_custkey * 2 AS v FROM orders EXCEPT SELECT c_custkey FROM customer)")
def setxor1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return sorting.setxor1d(a, b.withColumn("o_custkey", F.col("o_custkey") * 2), "c_custkey", "o_custkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return sorting.isin(a, "c_custkey", b, "o_custkey").select("c_custkey", "found")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def in1d_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return sorting.members(a, "c_custkey", b, "o_custkey", invert=True).select("c_custkey")


@query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) - 1 AS i0, o_orderkey AS v FROM orders")
def lexsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.lexsort(read(spark, sf_dir, "orders"), ["o_totalprice", "o_orderpriority"], "o_orderkey")


@query("SELECT DISTINCT o.o_totalprice, (SELECT count(*) FROM part p WHERE p.p_retailprice < o.o_totalprice / 100) AS insertion FROM (SELECT DISTINCT o_totalprice FROM orders) o")
def searchsorted_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100).alias("q"), "o_totalprice")
    found = sorting.searchsorted_frame(read(spark, sf_dir, "part"), "p_retailprice", orders, "q")
    return orders.distinct().join(found, "q").select("o_totalprice", "insertion")


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) + 0.0 AS total FROM events")
def cumsum_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.running_total(read(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], F.col("value"), "total")
    return out.select("event_id", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("SELECT user_id, round(sum((value + nxt) * (t2 - t) / 2), 4) + 0.0 AS area FROM (SELECT user_id, value, epoch(ts) AS t, lead(value) OVER w AS nxt, lead(epoch(ts)) OVER w AS t2 FROM (SELECT user_id, ts, avg(value) AS value FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY user_id")
def trapezoid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.avg("value").alias("value")).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = numeric.trapezoid_columns(points, "t", "value", ["user_id"])
    return out.select("user_id", F.when(F.count("*").over(_per_user()) > 0, F.round("area", 4) + F.lit(0.0)).alias("area"))


def _per_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id")


@query("SELECT CAST(event_id // 8 AS BIGINT) AS i0, CAST(sum((value > 100)::INT << (7 - event_id % 8)::INT) AS INTEGER) AS v FROM events GROUP BY ALL")
def packbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = read(spark, sf_dir, "events").select(F.col("event_id").alias("i0"), (F.col("value") > 100).cast("int").alias("v"))
    return bits.packbits(flags, "i0", "v")


@query("SELECT CAST(c_custkey * 8 + b AS BIGINT) AS i0, CAST((c_nationkey >> (7 - b)::INT) & 1 AS INTEGER) AS v FROM customer, range(8) g(b)")
def unpackbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bits.unpackbits(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i0"), F.col("c_nationkey").alias("v")), "i0", "v")


@query("SELECT CAST(0 AS INTEGER) AS power, round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS coefficient FROM lineitem UNION ALL SELECT 1, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 FROM lineitem")
def polyfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numeric.polyfit(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1)
    rows = spark.createDataFrame([(k, float(c)) for k, c in enumerate(found)], "power int, coefficient double")
    return rows.select("power", (F.round("coefficient", 3) + F.lit(0.0)).alias("coefficient"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS slope FROM lineitem")
def lstsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    x, *_ = linalg.lstsq(lines, ["l_quantity", "one"], "l_extendedprice")
    return spark.createDataFrame([(float(x[0]),)], "slope double").select((F.round("slope", 3) + F.lit(0.0)).alias("slope"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def windowed_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = aggregates.windowed(events, "ts", "6 hours", [F.count("*").alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("total")], ["event_type"])
    return out.select(*(F.col(c).cast("timestamp_ntz") if c.startswith("window") else F.col(c) for c in out.columns))


def random_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Generator(spark, 42).normal(0.0, 1.0, size=(1000,)).df


query()(random_normal)
