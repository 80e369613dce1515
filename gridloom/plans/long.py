"""Queries of long arrays: transforms, selection, convolution, as-of scans, tall and tiled matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array
from ..operators import fourier, linalg, numeric, scans, selection, sorting, tall, tiles
from .arrays import _register
from .catalog import query, read, rounded

_CENTS = "CAST(round({} * 100) AS BIGINT)"
#: Frequencies, or places, that are looked at: 16 all over an axis of n.
_SOME = "SELECT DISTINCT (j * 611) % n AS k FROM range(16) r(j), size"


def signal(spark: SparkSession, sf_dir: str, value: str = "value", table: str = "events", key: str = "event_id") -> Array:
    """A numbered column as an array."""
    rows = read(spark, sf_dir, table)
    return Array(rows.selectExpr(f"{key} AS i0", f"{value} AS v"), (rows.count(),))


def _some(a: Array) -> DataFrame:
    wanted = sorted({j * 611 % a.shape[0] for j in range(16)})
    return a.df.filter(F.col("i0").isin(wanted))


def _parts(df: DataFrame, places: int = 3) -> DataFrame:
    return df.select("i0", *(rounded(F.col(f"v.{x}"), places).alias(x) for x in ("re", "im")))


def _sum(re: str, im: str, scale: str = "1") -> str:
    return f"SELECT CAST(k AS BIGINT) AS i0, round(sum({re}) / {scale}, 3) AS re, round(sum({im}) / {scale}, 3) AS im"


_ANGLE = "2 * pi() * ((k * event_id) % n) / n"
_SIZE = "WITH size AS (SELECT count(*) AS n FROM events), f AS (" + _SOME + ") "
_PLUS = " + 0.0"


@query(_SIZE + _sum(f"value * cos({_ANGLE})", f"-value * sin({_ANGLE})") + " FROM events, f, size GROUP BY k")
def fft_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(_some(fourier.fft(signal(spark, sf_dir))))


@query(_SIZE + _sum(f"value * cos({_ANGLE}) - user_id * sin({_ANGLE})", f"value * sin({_ANGLE}) + user_id * cos({_ANGLE})", "any_value(n)") + " FROM events, f, size GROUP BY k")
def ifft_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(_some(fourier.ifft(signal(spark, sf_dir, "named_struct('re', value, 'im', CAST(user_id AS DOUBLE))"))))


@query(_SIZE + _sum(f"value * cos({_ANGLE})", f"-value * sin({_ANGLE})") + " FROM events, (SELECT k FROM f, size WHERE k <= n // 2) f, size GROUP BY k")
def rfft_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = signal(spark, sf_dir)
    return _parts(_some(Array(fourier.rfft(a).df, a.shape)))


@query(
    "WITH size AS (SELECT 2 * (count(*) - 1) AS n FROM events), f AS (" + _SOME + ") "
    + f"SELECT CAST(k AS BIGINT) AS i0, round(sum(CASE WHEN event_id IN (0, n // 2) THEN 1 ELSE 2 END * value * cos({_ANGLE})) / any_value(n), 3){_PLUS} AS v FROM events, f, size GROUP BY k"
)
def irfft_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fourier.irfft(signal(spark, sf_dir))
    return _some(out).select("i0", (rounded(F.col("v"), 3) + 0.0).alias("v"))


for _name, _build, _sql in (
    ("fft2_cells", lambda s, a: fourier.fft2(a).map(lambda z: z["re"]), "SELECT CAST(p AS BIGINT) AS i0, CAST(q AS BIGINT) AS i1, $V(sum(v * cos(2 * pi() * (p * i0 / 25.0 + q * i1 / 12.0))))V$ AS v FROM m, range(25) a(p), range(12) b(q) GROUP BY p, q"),
    ("ifft_cells", lambda s, a: fourier.ifft(a).map(lambda z: z["im"]), "SELECT i0, CAST(q AS BIGINT) AS i1, $V(sum(v * sin(2 * pi() * (q * i1 % 12) / 12.0)) / 12)V$ AS v FROM m, range(12) b(q) GROUP BY i0, q"),
    ("irfft_cells", lambda s, a: fourier.irfft(a), "SELECT i0, CAST(q AS BIGINT) AS i1, $V(sum(CASE WHEN i1 IN (0, 11) THEN 1 ELSE 2 END * v * cos(2 * pi() * (q * i1 % 22) / 22.0)) / 22)V$ AS v FROM m, range(22) b(q) GROUP BY i0, q"),
    ("einsum_chain", lambda s, a: linalg.einsum("ij,kj,kl->il", a, a, a.map(lambda v: v / 1e6)), "SELECT a.i0, c.i1, $V(sum(a.v * b.v * c.v / 1e6))V$ AS v FROM m a JOIN m b ON a.i1 = b.i1 JOIN m c ON b.i0 = c.i0 GROUP BY a.i0, c.i1"),
):
    _register(_name, _build, _sql, 2)


# selection


@query("SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS v FROM lineitem")
def median_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.quantile(read(spark, sf_dir, "lineitem"), "l_extendedprice", [0.5])
    return out.select(rounded(F.col("v"), 6).alias("v"))


_SHARES = (0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0)


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(l_extendedprice * (1 - l_discount), {q}), 8) AS v FROM lineitem" for q in _SHARES))
def quantile_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.quantile(read(spark, sf_dir, "lineitem"), F.expr("l_extendedprice * (1 - l_discount)"), _SHARES)
    return out.select("q", rounded(F.col("v"), 8).alias("v"))


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(l_quantity, {q / 100}), 6) AS v FROM lineitem WHERE l_linenumber <> 3" for q in (10, 50, 90)))
def nanpercentile_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.expr("CASE WHEN l_linenumber = 3 THEN double('NaN') ELSE l_quantity END")
    out = selection.nanpercentile(read(spark, sf_dir, "lineitem"), values, [10, 50, 90])
    return out.select("q", rounded(F.col("v"), 6).alias("v"))


_PARTED = """WITH size AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey AS i, o_totalprice AS v FROM orders),
cutting AS (SELECT v AS p FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM r), size WHERE k = n // 3),
c AS (SELECT i, v, CASE WHEN v < p THEN 0 WHEN v = p THEN 1 ELSE 2 END AS class FROM r, cutting)
SELECT CAST(row_number() OVER (ORDER BY class, i) - 1 AS BIGINT) AS i0, {} AS v FROM c"""


def _orders(spark: SparkSession, sf_dir: str) -> Array:
    return signal(spark, sf_dir, "o_totalprice", "orders", "o_orderkey")


@query(_PARTED.format("v"))
def partition_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _orders(spark, sf_dir)
    return sorting.partition(a, a.shape[0] // 3).df


@query(_PARTED.format("i"))
def argpartition_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _orders(spark, sf_dir)
    return sorting.argpartition(a, a.shape[0] // 3).df


# convolution: whole numbers, so that every way of summing gives the same


def _whole(a: Array) -> DataFrame:
    return a.df.select("i0", F.round("v").cast("bigint").alias("v"))


_PRODUCTS = "SELECT {} AS i0, CAST(sum(" + _CENTS.format("value") + " * p_size) AS BIGINT) AS v FROM events, part GROUP BY ALL"


def _cents(spark: SparkSession, sf_dir: str) -> tuple[Array, Array]:
    return signal(spark, sf_dir, "CAST(round(value * 100) AS DOUBLE)"), signal(spark, sf_dir, "CAST(p_size AS DOUBLE)", "part", "p_partkey")


@query(_PRODUCTS.format("event_id + p_partkey"))
def convolve_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(numeric.convolve(*_cents(spark, sf_dir)))


@query(_PRODUCTS.format("event_id + p_partkey"))
def convolve_by_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(numeric.convolve(*_cents(spark, sf_dir), max_kernel=0))


@query(
    "WITH size AS (SELECT count(*) AS m FROM part) SELECT * FROM ("
    + _PRODUCTS.format("event_id - p_partkey")
    + ") WHERE i0 >= 0 AND i0 <= (SELECT count(*) FROM events) - (SELECT m FROM size)"
)
def correlate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(numeric.correlate(*_cents(spark, sf_dir), "valid"))


# as-of scans


@query("""WITH q AS (SELECT o_orderkey, o_totalprice / 250.0 AS x FROM orders), e AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi, arg_min(p_retailprice, p_partkey) AS first, arg_max(p_retailprice, p_partkey) AS last FROM part)
SELECT o_orderkey, round(CASE WHEN x < lo THEN first WHEN x >= hi THEN last ELSE a.p_retailprice + (x - a.p_partkey) * (b.p_retailprice - a.p_retailprice) END, 6) AS v
FROM q, e LEFT JOIN part a ON a.p_partkey = CAST(floor(x) AS BIGINT) LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def interp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice / 250 AS x")
    out = scans.interp(queries, "x", read(spark, sf_dir, "part"), "p_partkey", "p_retailprice")
    return out.select("o_orderkey", rounded(F.col("interp"), 6).alias("v"))


@query("""WITH q AS (SELECT o_orderkey, 899 + (o_orderkey % 1030) / 10.0 AS x FROM orders), d AS (SELECT DISTINCT x FROM q)
SELECT o_orderkey, n AS bin FROM q JOIN (SELECT x, (SELECT count(*) FROM part WHERE p_retailprice <= x) AS n FROM d) USING (x)""")
def digitize_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "899 + (o_orderkey % 1030) / 10D AS x")
    return scans.digitize(queries, "x", read(spark, sf_dir, "part"), "p_retailprice").select("o_orderkey", "bin")


@query("""WITH p AS (SELECT c_acctbal AS x, max(c_custkey) AS c_custkey FROM customer GROUP BY c_acctbal)
SELECT event_id, c_custkey FROM (SELECT event_id, value * 10 AS y FROM events) e ASOF LEFT JOIN p ON e.y >= p.x""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "events").selectExpr("event_id", "value * 10 AS y")
    return scans.asof_join(queries, "y", read(spark, sf_dir, "customer"), "c_acctbal", ["c_custkey"]).select("event_id", "c_custkey")


# tall and tiled matrices


def _small(spark: SparkSession, values, places: int) -> DataFrame:
    rows = [(i, j, float(v)) for i, line in enumerate(values.tolist()) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "i0 bigint, i1 bigint, v double").withColumn("v", rounded(F.col("v"), places) + 0.0)


@query(" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i0, CAST({j} AS BIGINT) AS i1, round({f}({y}, l_quantity), 8) + 0.0 AS v FROM lineitem" for i, f in enumerate(("regr_intercept", "regr_slope")) for j, y in enumerate(("l_extendedprice / 1e4", "l_tax"))))
def lstsq_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two right sides on a constant and a slope."""
    x, *_ = tall.lstsq_columns(read(spark, sf_dir, "lineitem"), [F.lit(1.0), "l_quantity"], [F.expr("l_extendedprice / 1e4"), "l_tax"])
    return _small(spark, x, 8)


def _matrix(spark: SparkSession, sf_dir: str) -> Array:
    """Prices in thousands beside customers' numbers in hundreds, two columns."""
    rows = read(spark, sf_dir, "orders")
    cells = rows.selectExpr("o_orderkey AS i0", "posexplode(array(o_totalprice / 1e5, o_custkey / 1e2)) AS (i1, v)")
    return Array(cells.select("i0", F.col("i1").cast("bigint").alias("i1"), "v"), (rows.count(), 2))


_XY = "WITH s AS (SELECT o_orderkey, o_totalprice / 1e5 AS x, o_custkey / 1e2 AS y FROM orders), r AS (SELECT sqrt(sum(x * x)) AS a, sum(x * y) / sqrt(sum(x * x)) AS b, sqrt(sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) AS c FROM s) "


@query(_XY + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i0, CAST({j} AS BIGINT) AS i1, round({v}, 6) + 0.0 AS v FROM r" for i, j, v in ((0, 0, "a"), (0, 1, "b"), (1, 0, "0.0::DOUBLE"), (1, 1, "c"))))
def qr_tall_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(spark, tall.qr(_matrix(spark, sf_dir))[1], 6)


@query(_XY + "SELECT o_orderkey AS i0, CAST(j AS BIGINT) AS i1, round(CASE j WHEN 0 THEN x / a ELSE (y - b * x / a) / c END, 7) + 0.0 AS v FROM s, r, range(2) q(j)")
def qr_tall_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tall.qr(_matrix(spark, sf_dir))[0]
    return q.df.select("i0", "i1", (rounded(F.col("v"), 7) + 0.0).alias("v"))


_VALUES = "sqrt((t + {} sqrt(t * t - 4 * d)) / 2)"


@query(
    _XY + ", t AS (SELECT a * a + b * b + c * c AS t, a * a * c * c AS d FROM r) "
    + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, round({_VALUES.format(s)}, 5) + 0.0 AS v FROM t" for i, s in enumerate(("", "-")))
)
def svdvals_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(spark, tall.svdvals(_matrix(spark, sf_dir))[:, None], 5)


@query("WITH a AS (SELECT event_id // 100 AS i, event_id % 100 AS j, " + _CENTS.format("value") + " AS v FROM events) SELECT a.i AS i0, b.i AS i1, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN a b ON a.j = b.j GROUP BY a.i, b.i")
def matmul_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of 100 columns times its transpose, by tiles."""
    rows = read(spark, sf_dir, "events")
    a = Array(rows.selectExpr("event_id div 100 AS i0", "event_id % 100 AS i1", "CAST(round(value * 100) AS DOUBLE) AS v"), (-(-rows.count() // 100), 100))
    b = Array(a.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), a.shape[::-1])
    out = tiles.matmul(a, b, 32)
    return out.df.select("i0", "i1", F.round("v").cast("bigint").alias("v"))
