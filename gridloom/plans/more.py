"""More queries of arrays: constructors, selections, moments, small factorisations, files and types."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import methods  # noqa: F401  arrays get their operators
from ..arrays import Array, array, from_function
from ..functions import complexes, dates, dtypes, math as m, predicates
from ..operators import linalg, numeric, reductions, shape, sorting, windows
from ..sources import files
from ..storage import shared_dir
from .arrays import _register, matrix
from .catalog import query, read, rounded

_CELLS = "CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1"
_CORNER = "(SELECT 4000 + sum(v) FILTER (i0 = 0 AND i1 = 0) AS p, sum(v) FILTER (i0 = 0 AND i1 = 1) AS q, sum(v) FILTER (i0 = 1 AND i1 = 0) AS r, 3000 + sum(v) FILTER (i0 = 1 AND i1 = 1) AS s FROM m WHERE i0 < 2 AND i1 < 2)"


def _corner(s: SparkSession, a: Array) -> Array:
    """The upper left 2 x 2 cells plus a diagonal."""
    return a[:2, :2] + array(s, [[4000.0, 0.0], [0.0, 3000.0]])


def _symmetric(s: SparkSession, a: Array) -> Array:
    """B^T B of the corner, in units that keep its numbers short."""
    b = _corner(s, a).map(lambda v: v / 1000)
    return linalg.matmul(shape.transpose(b), b)


_SYMMETRIC = f"(SELECT (p * p + r * r) / 1e6 AS x, (p * q + r * s) / 1e6 AS y, (q * q + s * s) / 1e6 AS z FROM {_CORNER})"
_FOUR = lambda e00, e01, e10, e11, source: f"SELECT {_CELLS}, $V(CASE WHEN a.i = 0 AND b.i = 0 THEN {e00} WHEN a.i = 0 THEN {e01} WHEN b.i = 0 THEN {e10} ELSE {e11} END)V$ AS v FROM {source}, range(2) a(i), range(2) b(i)"
_TWO = lambda e0, e1, source: f"SELECT CAST(a.i AS BIGINT) AS i0, $V(CASE a.i WHEN 0 THEN {e0} ELSE {e1} END)V$ AS v FROM {source}, range(2) a(i)"
_ROOT = "sqrt((x - z) * (x - z) / 4 + y * y)"

for _name, _build, _sql, _places in (
    # constructors
    ("zeros", lambda s, a: shape.zeros(s, (2, 3)), f"SELECT {_CELLS}, 0.0::DOUBLE AS v FROM range(2) a(i), range(3) b(i)", 3),
    ("ones", lambda s, a: shape.ones(s, (2, 3)), f"SELECT {_CELLS}, 1.0::DOUBLE AS v FROM range(2) a(i), range(3) b(i)", 3),
    ("full", lambda s, a: shape.full(s, (2, 3), 2.5), f"SELECT {_CELLS}, 2.5::DOUBLE AS v FROM range(2) a(i), range(3) b(i)", 3),
    ("zeros_like", lambda s, a: shape.zeros_like(a), "SELECT i0, i1, 0.0::DOUBLE AS v FROM m", 3),
    ("ones_like", lambda s, a: shape.ones_like(a), "SELECT i0, i1, 1.0::DOUBLE AS v FROM m", 3),
    ("full_like", lambda s, a: shape.full_like(a, 7.0), "SELECT i0, i1, 7.0::DOUBLE AS v FROM m", 3),
    ("empty_like", lambda s, a: shape.empty_like(a).map(lambda v: v * 0), "SELECT i0, i1, 0.0::DOUBLE AS v FROM m", 3),
    ("identity", lambda s, a: shape.identity(s, 3), f"SELECT {_CELLS}, (a.i = b.i)::INT::DOUBLE AS v FROM range(3) a(i), range(3) b(i)", 3),
    ("fromfunction", lambda s, a: from_function(s, (3, 4), lambda i, j: i * 10.0 + j), f"SELECT {_CELLS}, (a.i * 10 + b.i)::DOUBLE AS v FROM range(3) a(i), range(4) b(i)", 3),
    ("asarray", lambda s, a: array(s, [[1.5, 2.5], [3.5, 4.5]]), f"SELECT {_CELLS}, (1.5 + a.i * 2 + b.i)::DOUBLE AS v FROM range(2) a(i), range(2) b(i)", 3),
    ("kaiser", lambda s, a: shape.kaiser(s, 9, 5.0), "SELECT CAST(i AS BIGINT) AS i0, $V(list_sum([pow(25 * (1 - pow(i / 4.0 - 1, 2)) / 4, k) / pow(factorial(k::INT)::DOUBLE, 2) FOR k IN range(20)]) / list_sum([pow(25 / 4.0, k) / pow(factorial(k::INT)::DOUBLE, 2) FOR k IN range(20)]))V$ AS v FROM range(9) g(i)", 6),
    ("mgrid", lambda s, a: shape.mgrid(s)[0:2, 1:7:2], f"SELECT CAST(k AS BIGINT) AS i0, CAST(a.i AS BIGINT) AS i1, CAST(b.i AS BIGINT) AS i2, CASE k WHEN 0 THEN a.i ELSE 1 + 2 * b.i END::DOUBLE AS v FROM range(2) g(k), range(2) a(i), range(3) b(i)", 3),
    ("ogrid", lambda s, a: shape.ogrid(s)[0:2, 0:1:5j][1], "SELECT CAST(0 AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, i / 4.0 AS v FROM range(5) g(i)", 3),
    ("ix_", lambda s, a: shape.ix_(shape.arange(s, 3), shape.arange(s, 4))[1], "SELECT CAST(0 AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, i::DOUBLE AS v FROM range(4) g(i)", 3),
    ("diag_indices", lambda s, a: shape.diag_indices(s, 4), "SELECT CAST(i AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1 FROM range(4) g(i)", 3),
    ("diag_indices_from", lambda s, a: shape.diag_indices_from(a[:12]), "SELECT CAST(i AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1 FROM range(12) g(i)", 3),
    ("tril_indices_from", lambda s, a: shape.tril_indices_from(a), "SELECT i0, i1 FROM m WHERE i1 <= i0", 3),
    ("triu_indices_from", lambda s, a: shape.triu_indices_from(a, 2), "SELECT i0, i1 FROM m WHERE i1 >= i0 + 2", 3),
    ("mask_indices", lambda s, a: shape.mask_indices(s, 4, shape.triu, 1), f"SELECT {_CELLS} FROM range(4) a(i), range(4) b(i) WHERE b.i > a.i", 3),
    # shape and selection
    ("hsplit", lambda s, a: shape.hsplit(a, 3)[1], "SELECT i0, i1 - 4 AS i1, $V(v)V$ AS v FROM m WHERE i1 BETWEEN 4 AND 7", 3),
    ("vsplit", lambda s, a: shape.vsplit(a, 5)[4], "SELECT i0 - 20 AS i0, i1, $V(v)V$ AS v FROM m WHERE i0 >= 20", 3),
    ("dsplit", lambda s, a: shape.dsplit(shape.reshape(a, (25, 3, 4)), 2)[1], "SELECT i0, i1 // 4 AS i1, i1 % 4 - 2 AS i2, $V(v)V$ AS v FROM m WHERE i1 % 4 >= 2", 3),
    ("column_stack", lambda s, a: shape.column_stack([a, shape.arange(s, 25).map(lambda v: v.cast("double"))]), "SELECT i0, i1, $V(v)V$ AS v FROM m UNION ALL SELECT CAST(i AS BIGINT), 12, i::DOUBLE FROM range(25) g(i)", 3),
    ("broadcast_arrays", lambda s, a: shape.broadcast_arrays(a, shape.ones(s, (25, 1)))[1], "SELECT i0, i1, 1.0::DOUBLE AS v FROM m", 3),
    ("atleast_3d", lambda s, a: shape.atleast_3d(a), "SELECT i0, i1, CAST(0 AS BIGINT) AS i2, $V(v)V$ AS v FROM m", 3),
    ("atleast_2d", lambda s, a: shape.atleast_2d(a[3]), "SELECT CAST(0 AS BIGINT) AS i0, i1, $V(v)V$ AS v FROM m WHERE i0 = 3", 3),
    ("rollaxis", lambda s, a: shape.rollaxis(a, 1), "SELECT i1 AS i0, i0 AS i1, $V(v)V$ AS v FROM m", 3),
    ("matrix_transpose", lambda s, a: shape.matrix_transpose(a), "SELECT i1 AS i0, i0 AS i1, $V(v)V$ AS v FROM m", 3),
    ("diag", lambda s, a: shape.diag(a), "SELECT i0, $V(v)V$ AS v FROM m WHERE i0 = i1", 3),
    ("nonzero", lambda s, a: shape.nonzero(a.map(lambda v: v > 100)), "SELECT i0, i1 FROM m WHERE v > 100", 3),
    ("put_along_axis", lambda s, a: shape.put_along_axis(a, shape.reshape(sorting.argsort(a, 1)[:, -1], (25, 1)), shape.zeros(s, (25, 1)), 1), "SELECT i0, i1, $V(CASE WHEN row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1 DESC) = 1 THEN 0.0 ELSE v END)V$ AS v FROM m", 3),
    ("put_repeated", lambda s, a: shape.put(a, array(s, [5, 7, 5]), array(s, [1.0, 2.0, 3.0])), "SELECT i0, i1, $V(CASE i0 * 12 + i1 WHEN 5 THEN 3.0 WHEN 7 THEN 2.0 ELSE v END)V$ AS v FROM m", 3),
    ("getitem", lambda s, a: a[1::3, ::-2], "SELECT (i0 - 1) // 3 AS i0, (11 - i1) // 2 AS i1, $V(v)V$ AS v FROM m WHERE i0 % 3 = 1 AND i1 % 2 = 1", 3),
    ("getitem_mask", lambda s, a: a[a > 100.0], "SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, $V(v)V$ AS v FROM m WHERE v > 100", 3),
    ("setitem", lambda s, a: a.assigned((slice(0, 5), slice(None, None, 2)), -1.0), "SELECT i0, i1, $V(CASE WHEN i0 < 5 AND i1 % 2 = 0 THEN -1.0 ELSE v END)V$ AS v FROM m", 3),
    ("setitem_array", lambda s, a: a.assigned(2, a[3]), "SELECT x.i0, x.i1, $V(CASE WHEN x.i0 = 2 THEN y.v ELSE x.v END)V$ AS v FROM m x JOIN m y ON y.i0 = 3 AND y.i1 = x.i1", 3),
    # arithmetic of arrays
    ("array_arithmetic", lambda s, a: (2.0 * a - a[0] + 1) / 4.0, "SELECT x.i0, x.i1, $V((2 * x.v - y.v + 1) / 4)V$ AS v FROM m x JOIN m y ON y.i0 = 0 AND y.i1 = x.i1", 6),
    ("array_reflected", lambda s, a: 7.5 % (a + 2.0) + 1000.0 // (a + 1.0) + 1.0 / (a + 1.0) + 2.0 ** (a * 0.0), "SELECT i0, i1, $V(7.5 % (v + 2) + floor(1000 / (v + 1)) + 1 / (v + 1) + 1)V$ AS v FROM m", 6),
    ("array_rmatmul", lambda s, a: [[1.0] * 25] @ a, "SELECT CAST(0 AS BIGINT) AS i0, i1, $V(sum(v))V$ AS v FROM m GROUP BY i1", 3),
    ("array_divmod", lambda s, a: divmod(a, 7.0)[1], "SELECT i0, i1, $V(v % 7.0)V$ AS v FROM m", 6),
    # moments and running products
    ("moment", lambda s, a: a.map(lambda v: v / 1000).moment(3, 1), "SELECT i0, $V(avg(pow(d, 3)))V$ AS v FROM (SELECT i0, v / 1000 - avg(v / 1000) OVER (PARTITION BY i0) AS d FROM m) GROUP BY i0", 6),
    ("moment_all", lambda s, a: a.map(lambda v: v / 1000).moment(2), "SELECT $V(var_pop(v / 1000))V$ AS v FROM m", 6),
    ("skew", lambda s, a: a.map(lambda v: v + F.col("i1")).skew(0), "SELECT i1 AS i0, $V(avg(pow(d, 3)) / pow(avg(d * d), 1.5))V$ AS v FROM (SELECT i1, v + i1 - avg(v + i1) OVER (PARTITION BY i1) AS d FROM m) GROUP BY i1", 6),
    ("kurtosis", lambda s, a: a.kurtosis(), "SELECT $V(avg(pow(d, 4)) / pow(avg(d * d), 2) - 3)V$ AS v FROM (SELECT v - avg(v) OVER () AS d FROM m)", 6),
    ("cumulative_prod", lambda s, a: windows.cumulative_prod(a.map(lambda v: 1 + v / 1e6), 0, True), "SELECT i0 + 1 AS i0, i1, $V(exp(sum(ln(1 + v / 1e6)) OVER (PARTITION BY i1 ORDER BY i0)))V$ AS v FROM m UNION ALL SELECT DISTINCT CAST(0 AS BIGINT), i1, 1.0 FROM m", 6),
    ("nancumprod", lambda s, a: windows.nancumprod(a.map(lambda v: F.when(v > 1e9, float("nan")).otherwise(1 + v / 1e6)), 1), "SELECT i0, i1, $V(exp(sum(ln(1 + v / 1e6)) OVER (PARTITION BY i0 ORDER BY i1)))V$ AS v FROM m", 6),
    ("cumprod_flat", lambda s, a: windows.cumprod(a.map(lambda v: 1 + v / 1e8)), "SELECT i0 * 12 + i1 AS i0, $V(exp(sum(ln(1 + v / 1e8)) OVER (ORDER BY i0, i1)))V$ AS v FROM m", 6),
    ("partition", lambda s, a: sorting.partition(a, 3, 1)[:, 3], "SELECT i0, $V(v)V$ AS v FROM (SELECT i0, v, row_number() OVER (PARTITION BY i0 ORDER BY v) AS n FROM m) WHERE n = 4", 3),
    ("argpartition", lambda s, a: shape.take_along_axis(a, sorting.argpartition(a, 3, 1), 1)[:, 3], "SELECT i0, $V(v)V$ AS v FROM (SELECT i0, v, row_number() OVER (PARTITION BY i0 ORDER BY v) AS n FROM m) WHERE n = 4", 3),
    # contractions and factorisations of cells of the table
    ("dot", lambda s, a: linalg.dot(a, shape.arange(s, 12).map(lambda v: v.cast("double"))), "SELECT i0, $V(sum(v * i1))V$ AS v FROM m GROUP BY i0", 3),
    ("multi_dot", lambda s, a: linalg.multi_dot([shape.ones(s, (1, 25)), a, shape.ones(s, (12, 1))]), "SELECT CAST(0 AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, $V(sum(v))V$ AS v FROM m", 3),
    ("einsum_chain", lambda s, a: linalg.einsum("ij,kj->ik", a[:3], a[3:5]), "SELECT a.i0, b.i0 - 3 AS i1, $V(sum(a.v * b.v))V$ AS v FROM m a JOIN m b ON a.i1 = b.i1 WHERE a.i0 < 3 AND b.i0 IN (3, 4) GROUP BY ALL", 3),
    ("inv", lambda s, a: linalg.inv(_corner(s, a)).map(lambda v: v * 1000), _FOUR("1000 * s / (p * s - q * r)", "-1000 * q / (p * s - q * r)", "-1000 * r / (p * s - q * r)", "1000 * p / (p * s - q * r)", _CORNER), 6),
    ("pinv", lambda s, a: linalg.pinv(_corner(s, a)).map(lambda v: v * 1000), _FOUR("1000 * s / (p * s - q * r)", "-1000 * q / (p * s - q * r)", "-1000 * r / (p * s - q * r)", "1000 * p / (p * s - q * r)", _CORNER), 6),
    ("solve_cells", lambda s, a: linalg.solve(_corner(s, a), array(s, [1000.0, 2000.0])), _TWO("(1000 * s - 2000 * q) / (p * s - q * r)", "(2000 * p - 1000 * r) / (p * s - q * r)", _CORNER), 6),
    ("det_cells", lambda s, a: linalg.det(_corner(s, a).map(lambda v: v / 1000)), f"SELECT $V((p * s - q * r) / 1e6)V$ AS v FROM {_CORNER}", 6),
    ("cholesky", lambda s, a: linalg.cholesky(_symmetric(s, a)), _FOUR("sqrt(x)", "0.0", "y / sqrt(x)", "sqrt(z - y * y / x)", _SYMMETRIC), 6),
    ("eigvalsh_cells", lambda s, a: linalg.eigvalsh(_symmetric(s, a)), _TWO(f"(x + z) / 2 - {_ROOT}", f"(x + z) / 2 + {_ROOT}", _SYMMETRIC), 6),
    ("eigh_values", lambda s, a: linalg.eigh(_symmetric(s, a))[0], _TWO(f"(x + z) / 2 - {_ROOT}", f"(x + z) / 2 + {_ROOT}", _SYMMETRIC), 6),
    ("svdvals_cells", lambda s, a: linalg.svdvals(_corner(s, a).map(lambda v: v / 1000)), _TWO(f"sqrt((x + z) / 2 + {_ROOT})", f"sqrt((x + z) / 2 - {_ROOT})", _SYMMETRIC), 6),
    ("svd_values", lambda s, a: linalg.svd(_corner(s, a).map(lambda v: v / 1000))[1], _TWO(f"sqrt((x + z) / 2 + {_ROOT})", f"sqrt((x + z) / 2 - {_ROOT})", _SYMMETRIC), 6),
    ("cond", lambda s, a: linalg.cond(_corner(s, a)), f"SELECT $V(sqrt(((x + z) / 2 + {_ROOT}) / ((x + z) / 2 - {_ROOT})))V$ AS v FROM {_SYMMETRIC}", 6),
    ("qr_gram", lambda s, a: linalg.matmul(shape.transpose(linalg.qr(_corner(s, a).map(lambda v: v / 1000))[1]), linalg.qr(_corner(s, a).map(lambda v: v / 1000))[1]), _FOUR("x", "y", "y", "z", _SYMMETRIC), 6),
    ("matrix_power_cells", lambda s, a: linalg.matrix_power(_corner(s, a).map(lambda v: v / 1000), 3), _FOUR("(p * p * p + 2 * p * q * r + q * r * s) / 1e9", "(p * p * q + p * q * s + q * q * r + q * s * s) / 1e9", "(p * p * r + p * r * s + q * r * r + r * s * s) / 1e9", "(s * s * s + 2 * s * q * r + p * q * r) / 1e9", _CORNER), 6),
    # user functions
    ("vectorize", lambda s, a: a.map(numeric.vectorize(lambda x: x * 2 + 1)), "SELECT i0, i1, $V(v * 2 + 1)V$ AS v FROM m", 3),
    ("frompyfunc", lambda s, a: a.map(lambda v: F.get(numeric.frompyfunc(lambda x: (x + 1, x - 1), 1, 2)(v), F.lit(1))), "SELECT i0, i1, $V(v - 1)V$ AS v FROM m", 3),
    # complex values
    ("complex_parts", lambda s, a: a.map(lambda v: complexes.real(complexes.conj(complexes.make(v, 2.0))) + complexes.imag(complexes.conj(complexes.make(v, 2.0)))), "SELECT i0, i1, $V(v - 2)V$ AS v FROM m", 3),
):
    _register(_name, _build, _sql, _places)


@query("SELECT true AS close")
def real_if_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).df.agg(complexes.real_if_close(complexes.make(F.col("v"), 0.0)).alias("close"))


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


@query("SELECT true AS same, false AS other, true AS close, false AS far")
def array_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matrix(spark, sf_dir)
    return _one(spark, same=methods.array_equal(a, a.T.T), other=methods.array_equal(a, a + 1.0), close=methods.allclose(a, a * (1 + 1e-9)), far=methods.allclose(a, a + 1.0))


@query("SELECT 'float64' AS promoted, 'int64' AS wide, true AS safe, false AS narrow, true AS kind, 9223372036854775807 AS most, 2.220446049250313e-16::DOUBLE AS eps")
def type_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, promoted=dtypes.promote_types("int64", "float32"), wide=dtypes.result_type("int8", "int64"), safe=dtypes.can_cast("int32", "int64"), narrow=dtypes.can_cast("float64", "int32"), kind=dtypes.issubdtype("int32", "integer"), most=dtypes.iinfo("int64").max, eps=dtypes.finfo("float64").eps)


@query("SELECT count(*) AS n, 2 AS dims FROM nation, range(12)")
def size_and_ndim(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matrix(spark, sf_dir)
    return _one(spark, dims=dtypes.ndim(a)).join(spark.range(dtypes.size(a)).agg(F.count("*").alias("n")))


@query("SELECT o_orderkey, o_orderdate, isodow(o_orderdate) NOT IN (5, 6) AND CAST(o_orderdate AS DATE) <> DATE '1996-01-02' AS value FROM orders")
def busdaycalendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = dates.BusDayCalendar((True, True, True, True, False, False, True), ("1996-01-02",))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", dates.is_busday("o_orderdate", calendar).alias("value"))


@query("SELECT event_id, nextafter(value, 1e9::DOUBLE) AS value FROM events")
def nextafter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", m.nextafter("value", F.lit(1e9)).alias("value"))


@query("SELECT CAST(floor((l_quantity - 1) * 10 / 50) AS BIGINT) AS b0, CAST(floor(l_discount * 4 / 0.1::DOUBLE) AS BIGINT) AS b1, count(*) AS n FROM lineitem WHERE l_discount < 0.1 AND l_quantity >= 1 AND l_quantity < 51 GROUP BY ALL")
def histogramdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").filter("l_discount < 0.1 and l_quantity >= 1 and l_quantity < 51")
    out = sorting.histogramdd(lines, ["l_quantity", "l_discount"], [10, 4], [(1.0, 51.0), (0.0, 0.1)])
    return out.filter("count > 0").select(F.col("b0").cast("bigint"), F.col("b1").cast("bigint"), F.col("count").alias("n"))


# files: what is written to the shared folder is read again


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("k"), "c_acctbal")


def _three(df: DataFrame) -> DataFrame:
    return df.select("k", (rounded(F.col("c_acctbal"), 3) + F.lit(0.0)).alias("c_acctbal"))


_CUSTOMERS = "SELECT CAST(c_custkey AS DOUBLE) AS k, round(c_acctbal, 3) + 0.0 AS c_acctbal FROM customer"


@query(_CUSTOMERS)
def savetxt_loadtxt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "text")
    files.savetxt(_table(spark, sf_dir), path)
    return _three(files.loadtxt(spark, path, ["k", "c_acctbal"]))


@query(_CUSTOMERS)
def genfromtxt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "text")
    files.savetxt(_table(spark, sf_dir), path, delimiter=",")
    return _three(files.genfromtxt(spark, path, ["k", "c_acctbal"]))


@query("SELECT k, c_acctbal FROM (" + _CUSTOMERS + ") ORDER BY k OFFSET 3 LIMIT 20")
def loadtxt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "text")
    files.savetxt(_table(spark, sf_dir).coalesce(1).sortWithinPartitions("k"), path)
    return _three(files.loadtxt(spark, path, ["k", "c_acctbal"], skip_header=3, max_rows=20))


_M_ROWS = """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS i0, CAST(month(o_orderdate) - 1 AS BIGINT) AS i1, round(sum(o_totalprice) / 1000, 3) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, coalesce(w, 0.0) AS v FROM range(25) a(i) CROSS JOIN range(12) b(i) LEFT JOIN c ON c.i0 = a.i AND c.i1 = b.i"""


@query(_M_ROWS)
def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "array")
    files.save(matrix(spark, sf_dir), path)
    return files.load(spark, path).df


@query(_M_ROWS)
def savez_loadz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, a = _path(spark, "arrays"), matrix(spark, sf_dir)
    files.savez_compressed(path, first=a, second=a.T)
    return files.loadz(spark, path, ["first", "second"])["second"].T.df


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS i0, value AS v FROM events")
def tofile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..arrays import from_column

    path, a = _path(spark, "values"), from_column(read(spark, sf_dir, "events"), "value", ["event_id"])
    files.tofile(a, path)
    rows = spark.read.text(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("double").alias("v"))
    return from_column(rows, "v", ["f", "n"]).df


@query("SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer")
def frombuffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # four bytes of each number, most significant first
    raw = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.unhex(F.lpad(F.hex("c_nationkey"), 8, "0")).alias("v"))
    return files.frombuffer(raw, "v", ">i4").select("k", F.get("v", F.lit(0)).alias("v"))
