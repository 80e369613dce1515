"""Constructors, windows, index arrays and small factorisations, each applied to a table.

A constructed array alone reads nothing; here it is as long as ``orders`` (or as large as
the matrix of prices) and meets the values there, so that the work grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array, array, from_function
from ..functions import complexes, dtypes
from ..operators import fourier, linalg, shape
from ..operators.random import Generator
from .arrays import _register, matrix
from .catalog import query, read, rounded
from .long import signal

_SERIES = "list_sum([pow(25 * (1 - pow(2.0 * i / (n - 1) - 1, 2)) / 4, k) / pow(factorial(k::INT)::DOUBLE, 2) FOR k IN range(20)]) / list_sum([pow(25 / 4.0, k) / pow(factorial(k::INT)::DOUBLE, 2) FOR k IN range(20)])"


def _on_signal(name: str, build: Callable[[SparkSession, int], Array], sql: str, where: str = "true", places: int = 3, plus: bool = False) -> None:
    """A query of a constructed 1-D array, times (or plus) the orders' prices; ``sql`` is its element i of n."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prices = signal(spark, sf_dir, "o_totalprice", "orders", "o_orderkey")
        both = build(spark, prices.shape[0]).df.select("i0", F.col("v").alias("w")).join(prices.df, "i0")
        value = F.col("v") + F.col("w") if plus else F.col("v") * F.col("w")
        return both.select("i0", (rounded(value, places) + 0.0).alias("v"))

    run.__name__ = name
    query(
        f"SELECT i AS i0, round(o_totalprice {'+' if plus else '*'} ({sql}), {places}) + 0.0 AS v "
        f"FROM (SELECT o_orderkey AS i, o_totalprice, (SELECT count(*) FROM orders) AS n FROM orders) WHERE {where}"
    )(run)


_TURN = "2 * pi() * i / (n - 1)"
for _name, _build, _sql in (
    ("ones", lambda s, n: shape.ones(s, n), "1.0"),
    ("full", lambda s, n: shape.full(s, n, 2.5), "2.5"),
    ("arange", lambda s, n: shape.arange(s, 2, 2 + 3 * n, 3), "2 + 3 * i"),
    ("linspace", lambda s, n: shape.linspace(s, 0, 1, n), "i / (n - 1)"),
    ("logspace", lambda s, n: shape.logspace(s, 0, 2, n), "pow(10.0, 2.0 * i / (n - 1))"),
    ("geomspace", lambda s, n: shape.geomspace(s, 1, 256, n), "pow(256.0, 1.0 * i / (n - 1))"),
    ("hanning", lambda s, n: shape.hanning(s, n), f"0.5 - 0.5 * cos({_TURN})"),
    ("hamming", lambda s, n: shape.hamming(s, n), f"0.54 - 0.46 * cos({_TURN})"),
    ("blackman", lambda s, n: shape.blackman(s, n), f"0.42 - 0.5 * cos({_TURN}) + 0.08 * cos(2 * {_TURN})"),
    ("bartlett", lambda s, n: shape.bartlett(s, n), "1 - abs(2.0 * i / (n - 1) - 1)"),
    ("kaiser", lambda s, n: shape.kaiser(s, n, 5.0), _SERIES),
    ("fftfreq", lambda s, n: fourier.fftfreq(s, n), "CASE WHEN i < (n + 1) // 2 THEN i ELSE i - n END / n"),
):
    _on_signal(_name, _build, _sql)
_on_signal("zeros", lambda s, n: shape.zeros(s, n), "0.0", plus=True)
_on_signal("rfftfreq", lambda s, n: fourier.rfftfreq(s, n), "i / n", where="i <= n // 2")


def _times(a: Array, b: Array) -> Array:
    return shape.elementwise(lambda x, y: x * y, a, b)


def _plus(a: Array, b: Array) -> Array:
    return shape.elementwise(lambda x, y: x + y, a, b)


def _met(a: Array, b: Array) -> Array:
    """Products where both have an element."""
    both = a.df.join(b.df.select("i0", "i1", F.col("v").alias("w")), ["i0", "i1"])
    return Array(both.select("i0", "i1", (F.col("v") * F.col("w")).alias("v")), a.shape)


def _taken(a: Array, where: DataFrame) -> Array:
    """The elements at index pairs."""
    return Array(a.df.join(where.select("i0", "i1"), ["i0", "i1"]), a.shape)


def _layers(a: Array, grid: Array) -> Array:
    """Every layer of a 3-d grid times the matrix."""
    cells = a.df.select(F.col("i0").alias("i1"), F.col("i1").alias("i2"), F.col("v").alias("w"))
    return Array(grid.df.join(cells, ["i1", "i2"]).select("i0", "i1", "i2", (F.col("v") * F.col("w")).alias("v")), grid.shape)


def _gram(s: SparkSession, a: Array) -> Array:
    """M^T M in millions, plus the unit matrix."""
    m = a.map(lambda v: v / 1000)
    return _plus(linalg.matmul(shape.transpose(m), m), shape.eye(s, 12))


_G = "(SELECT a.i1 AS i0, b.i1, sum(a.v * b.v) / 1e6 + (a.i1 = b.i1)::INT AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY a.i1, b.i1)"
_LAYERS = "SELECT CAST(k AS BIGINT) AS i0, i0 AS i1, i1 AS i2, $V(v * CASE k WHEN 0 THEN i0 ELSE i1 END)V$ AS v FROM m, range(2) g(k)"
_CELL = "SELECT i0, i1, $V({})V$ AS v FROM m"

for _name, _build, _sql in (
    ("zeros_like", lambda s, a: _plus(a, shape.zeros_like(a)), _CELL.format("v")),
    ("ones_like", lambda s, a: _times(a, shape.ones_like(a)), _CELL.format("v")),
    ("full_like", lambda s, a: _times(a, shape.full_like(a, 7.0)), _CELL.format("v * 7")),
    ("empty_like", lambda s, a: _plus(a, shape.empty_like(a).map(lambda v: v * 0)), _CELL.format("v")),
    ("identity", lambda s, a: _met(a, shape.identity(s, 25)), _CELL.format("v * (i0 = i1)::INT")),
    ("eye", lambda s, a: _met(a, shape.eye(s, 25).map(lambda v: 1 + v)), _CELL.format("v * (1 + (i0 = i1)::INT)")),
    ("tri", lambda s, a: _times(a, shape.tri(s, 25, 12, 1)), _CELL.format("v * (i1 <= i0 + 1)::INT")),
    ("diagflat", lambda s, a: _met(a, shape.diagflat(shape.arange(s, 12), 1)), _CELL.format("v * CASE WHEN i1 = i0 + 1 THEN i0 ELSE 0 END") + " WHERE i0 < 13"),
    ("fromfunction", lambda s, a: _times(a, from_function(s, (25, 12), lambda i, j: i * 10.0 + j)), _CELL.format("v * (i0 * 10 + i1)")),
    ("asarray", lambda s, a: _met(a, array(s, [[1.5, 2.5], [3.5, 4.5]])), _CELL.format("v * (1.5 + i0 * 2 + i1)") + " WHERE i0 < 2 AND i1 < 2"),
    ("meshgrid", lambda s, a: _times(a, shape.meshgrid(shape.arange(s, 12), shape.arange(s, 25))[1]), _CELL.format("v * i0")),
    ("ogrid", lambda s, a: _times(a, shape.ogrid(s)[0:25, 0:12][1]), _CELL.format("v * i1")),
    ("ix_", lambda s, a: _times(a, shape.ix_(shape.arange(s, 25), shape.arange(s, 12))[1]), _CELL.format("v * i1")),
    ("broadcast_arrays", lambda s, a: _times(a, shape.broadcast_arrays(a, shape.ones(s, (25, 1)))[1]), _CELL.format("v")),
    ("indices", lambda s, a: _layers(a, shape.indices(s, (25, 12))), _LAYERS),
    ("mgrid", lambda s, a: _layers(a, shape.mgrid(s)[0:25, 0:12]), _LAYERS),
    ("tril_indices", lambda s, a: _taken(a, shape.tril_indices(s, 25, 0, 12)), _CELL.format("v") + " WHERE i1 <= i0"),
    ("triu_indices", lambda s, a: _taken(a, shape.triu_indices(s, 25, 0, 12)), _CELL.format("v") + " WHERE i1 >= i0"),
    ("tril_indices_from", lambda s, a: _taken(a, shape.tril_indices_from(a)), _CELL.format("v") + " WHERE i1 <= i0"),
    ("triu_indices_from", lambda s, a: _taken(a, shape.triu_indices_from(a, 2)), _CELL.format("v") + " WHERE i1 >= i0 + 2"),
    ("diag_indices", lambda s, a: _taken(a, shape.diag_indices(s, 12)), _CELL.format("v") + " WHERE i0 = i1"),
    ("diag_indices_from", lambda s, a: _taken(a, shape.diag_indices_from(a[:12])), _CELL.format("v") + " WHERE i0 = i1"),
    ("mask_indices", lambda s, a: _taken(a, shape.mask_indices(s, 12, shape.triu, 1)), _CELL.format("v") + " WHERE i1 > i0"),
    # factorisations of a matrix from the table
    ("inv_round_trip", lambda s, a: linalg.matmul(linalg.inv(_gram(s, a)), _gram(s, a)), "SELECT i0, i1, (i0 = i1)::INT::DOUBLE AS v FROM m WHERE i0 < 12"),
    ("cholesky_round_trip", lambda s, a: linalg.matmul(linalg.cholesky(_gram(s, a)), shape.transpose(linalg.cholesky(_gram(s, a)))), f"SELECT i0, i1, $V(v)V$ AS v FROM {_G}"),
    ("solve", lambda s, a: linalg.solve(_gram(s, a), linalg.matmul(_gram(s, a), shape.arange(s, 12))), "SELECT DISTINCT i1 AS i0, i1::DOUBLE AS v FROM m"),
    ("matrix_power", lambda s, a: linalg.matrix_power(_gram(s, a), 2), f"SELECT a.i0, b.i1, $V(sum(a.v * b.v))V$ AS v FROM {_G} a JOIN {_G} b ON a.i1 = b.i0 GROUP BY a.i0, b.i1"),
    ("matrix_rank", lambda s, a: linalg.matrix_rank(_gram(s, a)), "SELECT count(DISTINCT i1)::DOUBLE AS v FROM m"),
    ("eigvalsh", lambda s, a: Array(linalg.eigvalsh(_gram(s, a)).df.agg(F.sum("v").alias("v")), ()), f"SELECT $V(sum(v))V$ AS v FROM {_G} WHERE i0 = i1"),
    ("det", lambda s, a: linalg.det(_gram(s, a)[:2, :2]), f"SELECT $V(max(v) FILTER (i0 = 0 AND i1 = 0) * max(v) FILTER (i0 = 1 AND i1 = 1) - pow(max(v) FILTER (i0 = 0 AND i1 = 1), 2))V$ AS v FROM {_G}"),
    ("svdvals", lambda s, a: Array(linalg.svdvals(a.map(lambda v: v / 1000)).df.agg(F.sum(F.col("v") * F.col("v")).alias("v")), ()), "SELECT $V(sum(v * v) / 1e6)V$ AS v FROM m"),
):
    _register(_name, _build, _sql, 2)


@query("SELECT count(*) AS n, true AS centred, true AS spread FROM orders")
def random_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw for each order: their number, and whether mean and deviation are within five errors of 0 and 1."""
    prices = signal(spark, sf_dir, "o_totalprice", "orders", "o_orderkey")
    both = Generator(spark, 42).normal(0.0, 1.0, size=prices.shape).df.join(prices.df.select("i0"), "i0")
    found = both.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    return found.select("n", (F.abs("mean") < 5 / F.sqrt("n")).alias("centred"), (F.abs(F.col("deviation") - 1) < 5 / F.sqrt(2 * F.col("n"))).alias("spread"))


@query("SELECT bool_and(v < 1e7) AS close FROM (SELECT o_totalprice AS v FROM orders)")
def real_if_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imaginary parts that are rounding errors of the values."""
    prices = signal(spark, sf_dir, "o_totalprice", "orders", "o_orderkey")
    return prices.df.agg(complexes.real_if_close(complexes.make(F.col("v"), F.col("v") * 1e-22)).alias("close"))


@query("SELECT count(*) AS n, 2 AS dims FROM nation, range(12)")
def size_and_ndim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of the matrix, counted, where the shape says as many."""
    a = matrix(spark, sf_dir)
    return a.df.agg(F.count("*").alias("n")).filter(F.col("n") == dtypes.size(a)).withColumn("dims", F.lit(dtypes.ndim(a)))


@query("SELECT 'float64' AS promoted, 'int64' AS wide, true AS safe, false AS narrow, true AS kind, 9223372036854775807 AS most, 2.220446049250313e-16::DOUBLE AS eps, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL")
def type_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a table's columns: the common ones, casts, kinds and limits, and how many values have them."""
    kinds = {"bigint": "int64", "double": "float64", "int": "int32"}
    rows = read(spark, sf_dir, "orders")
    key, price = (kinds[dict(rows.dtypes)[c]] for c in ("o_orderkey", "o_totalprice"))
    found = {
        "promoted": dtypes.promote_types(key, price), "wide": dtypes.result_type("int8", key), "safe": dtypes.can_cast("int32", key), "narrow": dtypes.can_cast(price, "int32"),
        "kind": dtypes.issubdtype(key, "integer"), "most": dtypes.iinfo(key).max, "eps": dtypes.finfo(price).eps,
    }
    return rows.filter("o_totalprice is not null").agg(F.count("*").alias("n")).select(*(F.lit(v).alias(k) for k, v in found.items()), "n")
