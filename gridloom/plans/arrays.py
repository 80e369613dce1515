"""Queries of n-d array operators in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array
from ..operators import fourier, linalg, numeric, reductions, shape, sorting, windows
from .catalog import query, read, rounded


def matrix(spark: SparkSession, sf_dir: str) -> Array:
    """nation x month: sums of order prices, dense, from one aggregation."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = orders.groupBy(F.col("c_nationkey").cast("bigint").alias("i0"), (F.month("o_orderdate") - 1).cast("bigint").alias("i1")).agg(rounded(F.sum("o_totalprice") / 1000, 3).alias("w"))
    every = shape.zeros(spark, (25, 12)).df.join(cells, ["i0", "i1"], "left")
    return Array(every.select("i0", "i1", F.coalesce("w", "v").alias("v")), (25, 12))


_M = """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS i0, CAST(month(o_orderdate) - 1 AS BIGINT) AS i1, round(sum(o_totalprice) / 1000, 3) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, coalesce(w, 0.0) AS v FROM range(25) a(i) CROSS JOIN range(12) b(i) LEFT JOIN c ON c.i0 = a.i AND c.i1 = b.i) """


def _register(name: str, build, sql: str, places: int = 3) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(spark, matrix(spark, sf_dir))
        df = out.df if isinstance(out, Array) else out
        return df.withColumn("v", rounded(F.col("v").cast("double"), places) + F.lit(0.0)) if "v" in df.columns else df

    run.__name__ = name
    query(_M + sql.replace("$V(", "round(").replace(")V$", f", {places}) + 0.0"))(run)


for _name, _build, _sql in (
    ("axis_sum", lambda s, a: reductions.reduce_axes(a, reductions.sum, 0), "SELECT i1 AS i0, $V(sum(v))V$ AS v FROM m GROUP BY i1"),
    ("axis_mean", lambda s, a: reductions.reduce_axes(a, reductions.mean, 1), "SELECT i0, $V(avg(v))V$ AS v FROM m GROUP BY i0"),
    ("axis_max", lambda s, a: reductions.reduce_axes(a, reductions.max, 1), "SELECT i0, $V(max(v))V$ AS v FROM m GROUP BY i0"),
    ("axis_argmax", lambda s, a: reductions.arg_reduce(a, reductions.argmax, 1), "SELECT i0, CAST(arg_max(i1, v) AS DOUBLE) AS v FROM m GROUP BY i0"),
    ("apply_over_axes", lambda s, a: reductions.apply_over_axes(reductions.sum, a, [0, 1]), "SELECT CAST(0 AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, $V(sum(v))V$ AS v FROM m"),
    ("axis_cumsum", lambda s, a: windows.cumsum(a, 1), "SELECT i0, i1, $V(sum(v) OVER (PARTITION BY i0 ORDER BY i1))V$ AS v FROM m"),
    ("cumsum_flat", lambda s, a: windows.cumsum(a), "SELECT i0 * 12 + i1 AS i0, $V(sum(v) OVER (ORDER BY i0, i1))V$ AS v FROM m"),
    ("nancumsum", lambda s, a: windows.nancumsum(a, 0), "SELECT i0, i1, $V(sum(v) OVER (PARTITION BY i1 ORDER BY i0))V$ AS v FROM m"),
    ("cumprod", lambda s, a: windows.cumprod(a.map(lambda v: 1 + v / 1e6), 1), "SELECT i0, i1, $V(exp(sum(ln(1 + v / 1e6)) OVER (PARTITION BY i0 ORDER BY i1)))V$ AS v FROM m"),
    ("cumulative_sum", lambda s, a: windows.cumulative_sum(a, 1, True), "SELECT i0, i1 + 1 AS i1, $V(sum(v) OVER (PARTITION BY i0 ORDER BY i1))V$ AS v FROM m UNION ALL SELECT DISTINCT i0, CAST(0 AS BIGINT), 0.0 FROM m"),
    ("diff", lambda s, a: windows.diff(a), "SELECT a.i0, a.i1, $V(b.v - a.v)V$ AS v FROM m a JOIN m b ON a.i0 = b.i0 AND b.i1 = a.i1 + 1"),
    ("ediff1d", lambda s, a: windows.ediff1d(a, [9.0], [7.0]), "SELECT i0 * 12 + i1 + 1 AS i0, $V(nxt - v)V$ AS v FROM (SELECT *, lead(v) OVER (ORDER BY i0, i1) AS nxt FROM m) WHERE nxt IS NOT NULL UNION ALL SELECT 0, 7.0 UNION ALL SELECT 300, 9.0"),
    ("unwrap", lambda s, a: windows.unwrap(a.map(lambda v: v % 6)), "SELECT i0, i1, $V(v + sum(f) OVER (PARTITION BY i0 ORDER BY i1))V$ AS v FROM (SELECT i0, i1, v, CASE WHEN abs(d) < pi() THEN 0.0 WHEN d IS NULL THEN 0.0 WHEN d > 0 THEN -2 * pi() ELSE 2 * pi() END AS f FROM (SELECT i0, i1, v, v - lag(v) OVER (PARTITION BY i0 ORDER BY i1) AS d FROM (SELECT i0, i1, v % 6 AS v FROM m)))"),
    ("sort_axis", lambda s, a: sorting.sort(a, 1), "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, $V(v)V$ AS v FROM m"),
    ("argsort_axis", lambda s, a: sorting.argsort(a, 1), "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, CAST(i1 AS DOUBLE) AS v FROM m"),
    ("sort_flat", lambda s, a: sorting.sort(shape.ravel(a)), "SELECT row_number() OVER (ORDER BY v) - 1 AS i0, $V(v)V$ AS v FROM m"),
    ("argsort_flat", lambda s, a: sorting.argsort(shape.ravel(a)), "SELECT row_number() OVER (ORDER BY v, i0 * 12 + i1) - 1 AS i0, CAST(i0 * 12 + i1 AS DOUBLE) AS v FROM m"),
    ("reshape", lambda s, a: shape.reshape(a, (-1, 10)), "SELECT (i0 * 12 + i1) // 10 AS i0, (i0 * 12 + i1) % 10 AS i1, $V(v)V$ AS v FROM m"),
    ("ravel", lambda s, a: shape.ravel(a), "SELECT i0 * 12 + i1 AS i0, $V(v)V$ AS v FROM m"),
    ("transpose", lambda s, a: shape.transpose(a), "SELECT i1 AS i0, i0 AS i1, $V(v)V$ AS v FROM m"),
    ("swapaxes", lambda s, a: shape.swapaxes(a, 0, 1), "SELECT i1 AS i0, i0 AS i1, $V(v)V$ AS v FROM m"),
    ("moveaxis", lambda s, a: shape.moveaxis(a, 0, 1), "SELECT i1 AS i0, i0 AS i1, $V(v)V$ AS v FROM m"),
    ("expand_dims", lambda s, a: shape.expand_dims(a, 1), "SELECT i0, CAST(0 AS BIGINT) AS i1, i1 AS i2, $V(v)V$ AS v FROM m"),
    ("squeeze", lambda s, a: shape.squeeze(shape.expand_dims(a, 1)), "SELECT i0, i1, $V(v)V$ AS v FROM m"),
    ("flip", lambda s, a: shape.flip(a), "SELECT 24 - i0 AS i0, 11 - i1 AS i1, $V(v)V$ AS v FROM m"),
    ("flipud", lambda s, a: shape.flipud(a), "SELECT 24 - i0 AS i0, i1, $V(v)V$ AS v FROM m"),
    ("fliplr", lambda s, a: shape.fliplr(a), "SELECT i0, 11 - i1 AS i1, $V(v)V$ AS v FROM m"),
    ("roll", lambda s, a: shape.roll(a, 5, 1), "SELECT i0, (i1 + 5) % 12 AS i1, $V(v)V$ AS v FROM m"),
    ("rot90", lambda s, a: shape.rot90(a), "SELECT 11 - i1 AS i0, i0 AS i1, $V(v)V$ AS v FROM m"),
    ("concatenate", lambda s, a: shape.concatenate([a, a], 1), "SELECT i0, i1, $V(v)V$ AS v FROM m UNION ALL SELECT i0, i1 + 12, $V(v)V$ FROM m"),
    ("stack", lambda s, a: shape.stack([a, a]), "SELECT CAST(k AS BIGINT) AS i0, i0 AS i1, i1 AS i2, $V(v)V$ AS v FROM m, range(2) g(k)"),
    ("vstack", lambda s, a: shape.vstack([a, a]), "SELECT i0 + 25 * k AS i0, i1, $V(v)V$ AS v FROM m, range(2) g(k)"),
    ("hstack", lambda s, a: shape.hstack([a, a]), "SELECT i0, i1 + 12 * k AS i1, $V(v)V$ AS v FROM m, range(2) g(k)"),
    ("dstack", lambda s, a: shape.dstack([a, a]), "SELECT i0, i1, CAST(k AS BIGINT) AS i2, $V(v)V$ AS v FROM m, range(2) g(k)"),
    ("block", lambda s, a: shape.block([[a, a], [a, a]]), "SELECT i0 + 25 * k AS i0, i1 + 12 * l AS i1, $V(v)V$ AS v FROM m, range(2) g(k), range(2) h(l)"),
    ("split", lambda s, a: shape.split(a, 5)[3], "SELECT i0 - 15 AS i0, i1, $V(v)V$ AS v FROM m WHERE i0 BETWEEN 15 AND 19"),
    ("array_split", lambda s, a: shape.array_split(a, 4)[1], "SELECT i0 - 7 AS i0, i1, $V(v)V$ AS v FROM m WHERE i0 BETWEEN 7 AND 12"),
    ("unstack", lambda s, a: shape.unstack(a, 1)[4], "SELECT i0, $V(v)V$ AS v FROM m WHERE i1 = 4"),
    ("repeat", lambda s, a: shape.repeat(a, 3, 1), "SELECT i0, i1 * 3 + k AS i1, $V(v)V$ AS v FROM m, range(3) g(k)"),
    ("tile", lambda s, a: shape.tile(a, (2, 3)), "SELECT i0 + 25 * k AS i0, i1 + 12 * l AS i1, $V(v)V$ AS v FROM m, range(2) g(k), range(3) h(l)"),
    ("append", lambda s, a: shape.append(a, a, 0), "SELECT i0 + 25 * k AS i0, i1, $V(v)V$ AS v FROM m, range(2) g(k)"),
    ("delete", lambda s, a: shape.delete(a, 3, 0), "SELECT CASE WHEN i0 > 3 THEN i0 - 1 ELSE i0 END AS i0, i1, $V(v)V$ AS v FROM m WHERE i0 <> 3"),
    ("insert", lambda s, a: shape.insert(a, 1, shape.full(s, (1, 12), 5.0), 0), "SELECT CASE WHEN i0 >= 1 THEN i0 + 1 ELSE i0 END AS i0, i1, $V(v)V$ AS v FROM m UNION ALL SELECT 1, CAST(k AS BIGINT), 5.0 FROM range(12) g(k)"),
    ("resize", lambda s, a: shape.resize(a, (2, 200)), "SELECT f // 200 AS i0, f % 200 AS i1, $V(v)V$ AS v FROM (SELECT i0 * 12 + i1 + 300 * k AS f, v FROM m, range(2) g(k)) WHERE f < 400"),
    ("pad", lambda s, a: shape.pad(a, 1), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, $V(coalesce(v, 0.0))V$ AS v FROM range(27) a(i) CROSS JOIN range(14) b(i) LEFT JOIN m ON m.i0 = a.i - 1 AND m.i1 = b.i - 1"),
    ("pad_edge", lambda s, a: shape.pad(a, 2, "edge"), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, $V(v)V$ AS v FROM range(29) a(i) CROSS JOIN range(16) b(i) JOIN m ON m.i0 = greatest(0, least(24, a.i - 2)) AND m.i1 = greatest(0, least(11, b.i - 2))"),
    ("diagonal", lambda s, a: shape.diagonal(a), "SELECT i0, $V(v)V$ AS v FROM m WHERE i0 = i1"),
    ("tril", lambda s, a: shape.tril(a), "SELECT i0, i1, $V(CASE WHEN i1 <= i0 THEN v ELSE 0.0 END)V$ AS v FROM m"),
    ("triu", lambda s, a: shape.triu(a, 1), "SELECT i0, i1, $V(CASE WHEN i1 >= i0 + 1 THEN v ELSE 0.0 END)V$ AS v FROM m"),
    ("fill_diagonal", lambda s, a: shape.fill_diagonal(a, -1.0), "SELECT i0, i1, $V(CASE WHEN i1 = i0 THEN -1.0 ELSE v END)V$ AS v FROM m"),
    ("broadcast_to", lambda s, a: shape.broadcast_to(a, (2, 25, 12)), "SELECT CAST(k AS BIGINT) AS i0, i0 AS i1, i1 AS i2, $V(v)V$ AS v FROM m, range(2) g(k)"),
    ("elementwise_broadcast", lambda s, a: shape.elementwise(lambda x, y: x * y, a, shape.arange(s, 12).map(lambda v: v.cast("double"))), "SELECT i0, i1, $V(v * i1)V$ AS v FROM m"),
    ("take", lambda s, a: shape.take(a, shape.arange(s, 0, 20, 5), 0), "SELECT i0 // 5 AS i0, i1, $V(v)V$ AS v FROM m WHERE i0 % 5 = 0 AND i0 < 20"),
    ("take_along_axis", lambda s, a: shape.take_along_axis(a, sorting.argsort(a, 1), 1), "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, $V(v)V$ AS v FROM m"),
    ("put", lambda s, a: shape.put(a, shape.arange(s, 0, 40, 10), shape.full(s, 1, 0.5)), "SELECT i0, i1, $V(CASE WHEN (i0 * 12 + i1) IN (0, 10, 20, 30) THEN 0.5 ELSE v END)V$ AS v FROM m"),
    ("compress", lambda s, a: shape.compress(shape.arange(s, 25).map(lambda v: v % 2 == 1), a, 0), "SELECT i0 // 2 AS i0, i1, $V(v)V$ AS v FROM m WHERE i0 % 2 = 1"),
    ("extract", lambda s, a: shape.extract(a.map(lambda v: v > 100), a), "SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, $V(v)V$ AS v FROM m WHERE v > 100"),
    ("argwhere", lambda s, a: shape.argwhere(a.map(lambda v: v > 100)), "SELECT i0, i1 FROM m WHERE v > 100"),
    ("flatnonzero", lambda s, a: shape.flatnonzero(a.map(lambda v: v > 100)), "SELECT CAST(i0 * 12 + i1 AS DOUBLE) AS v FROM m WHERE v > 100"),
    ("place", lambda s, a: shape.place(a, lambda v: v > 100, [1.0, 2.0]), "SELECT i0, i1, $V(CASE WHEN v > 100 THEN 1.0 + (n - 1) % 2 ELSE v END)V$ AS v FROM (SELECT *, sum((v > 100)::INT) OVER (ORDER BY i0, i1) AS n FROM m)"),
    ("putmask", lambda s, a: shape.putmask(a, lambda v: v > 100, [1.0, 2.0]), "SELECT i0, i1, $V(CASE WHEN v > 100 THEN 1.0 + (i0 * 12 + i1) % 2 ELSE v END)V$ AS v FROM m"),
    ("trim_zeros", lambda s, a: shape.trim_zeros(shape.pad(shape.ravel(a.map(lambda v: v + 1)), 3)), "SELECT i0 * 12 + i1 AS i0, $V(v + 1)V$ AS v FROM m"),
    ("matmul", lambda s, a: linalg.matmul(shape.transpose(a), a), "SELECT a.i1 AS i0, b.i1, $V(sum(a.v * b.v))V$ AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY ALL"),
    ("einsum", lambda s, a: linalg.einsum("ij,ij->j", a, a), "SELECT i1 AS i0, $V(sum(v * v))V$ AS v FROM m GROUP BY ALL"),
    ("tensordot", lambda s, a: linalg.tensordot(a, a, ([0], [0])), "SELECT a.i1 AS i0, b.i1, $V(sum(a.v * b.v))V$ AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY ALL"),
    ("inner", lambda s, a: linalg.inner(a, a), "SELECT i0, $V(sum(v * v))V$ AS v FROM m GROUP BY ALL"),
    ("vdot", lambda s, a: linalg.vdot(a, a), "SELECT $V(sum(v * v))V$ AS v FROM m"),
    ("outer", lambda s, a: linalg.outer(shape.unstack(a, 1)[0], shape.unstack(a, 0)[0]), "SELECT a.i0, b.i1, $V(a.v * b.v)V$ AS v FROM m a, m b WHERE a.i1 = 0 AND b.i0 = 0"),
    ("kron", lambda s, a: linalg.kron(a, shape.eye(s, 2)), "SELECT i0 * 2 + k AS i0, i1 * 2 + l AS i1, $V(CASE WHEN k = l THEN v ELSE 0.0 END)V$ AS v FROM m, range(2) g(k), range(2) h(l)"),
    ("trace", lambda s, a: linalg.trace(a), "SELECT $V(sum(v))V$ AS v FROM m WHERE i0 = i1"),
    ("vector_norm", lambda s, a: linalg.vector_norm(a), "SELECT $V(sqrt(sum(v * v)))V$ AS v FROM m"),
    ("matrix_norm", lambda s, a: linalg.matrix_norm(a, 1), "SELECT $V(max(s))V$ AS v FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY i1)"),
    ("cross", lambda s, a: linalg.cross(shape.array_split(a, 4, 1)[0], shape.array_split(a, 4, 1)[1]), "SELECT i0, CAST(k AS BIGINT) AS i1, $V(CASE k WHEN 0 THEN a1 * b2 - a2 * b1 WHEN 1 THEN a2 * b0 - a0 * b2 ELSE a0 * b1 - a1 * b0 END)V$ AS v FROM (SELECT i0, sum(v) FILTER (i1 = 0) AS a0, sum(v) FILTER (i1 = 1) AS a1, sum(v) FILTER (i1 = 2) AS a2, sum(v) FILTER (i1 = 3) AS b0, sum(v) FILTER (i1 = 4) AS b1, sum(v) FILTER (i1 = 5) AS b2 FROM m GROUP BY i0), range(3) g(k)"),
    ("convolve", lambda s, a: numeric.convolve(shape.ravel(a), [0.25, 0.5, 0.25], "same"), "SELECT i0, $V(0.5 * v + 0.25 * coalesce(p, 0.0) + 0.25 * coalesce(n, 0.0))V$ AS v FROM (SELECT f AS i0, v, lag(v) OVER (ORDER BY f) AS p, lead(v) OVER (ORDER BY f) AS n FROM (SELECT i0 * 12 + i1 AS f, v FROM m))"),
    ("correlate", lambda s, a: numeric.correlate(shape.ravel(a), [1.0, 2.0], "valid"), "SELECT f AS i0, $V(v + 2 * n)V$ AS v FROM (SELECT f, v, lead(v) OVER (ORDER BY f) AS n FROM (SELECT i0 * 12 + i1 AS f, v FROM m)) WHERE n IS NOT NULL"),
    ("gradient", lambda s, a: numeric.gradient(a, 2.0, 1), "SELECT i0, i1, $V(CASE WHEN p IS NULL THEN (n - v) / 2 WHEN n IS NULL THEN (v - p) / 2 ELSE (n - p) / 4 END)V$ AS v FROM (SELECT i0, i1, v, lag(v) OVER w AS p, lead(v) OVER w AS n FROM m WINDOW w AS (PARTITION BY i0 ORDER BY i1))"),
    ("trapezoid", lambda s, a: numeric.trapezoid(a, 0.5), "SELECT i0, $V(0.5 * sum(CASE WHEN i1 IN (0, 11) THEN v / 2 ELSE v END))V$ AS v FROM m GROUP BY i0"),
    ("apply_along_axis", lambda s, a: numeric.apply_along_axis(lambda x: float(x.max() - x.min()), 1, a), "SELECT i0, $V(max(v) - min(v))V$ AS v FROM m GROUP BY i0"),
    ("fftshift", lambda s, a: fourier.fftshift(a), "SELECT (i0 + 12) % 25 AS i0, (i1 + 6) % 12 AS i1, $V(v)V$ AS v FROM m"),
    ("ifftshift", lambda s, a: fourier.ifftshift(a), "SELECT (i0 + 13) % 25 AS i0, (i1 + 6) % 12 AS i1, $V(v)V$ AS v FROM m"),
    ("rfft_power", lambda s, a: fourier.rfft(a).map(lambda z: z["re"] * z["re"] + z["im"] * z["im"]), "SELECT m.i0, CAST(k AS BIGINT) AS i1, $V(pow(sum(v * cos(2 * pi() * k * i1 / 12)), 2) + pow(sum(v * sin(2 * pi() * k * i1 / 12)), 2))V$ AS v FROM m, range(7) g(k) GROUP BY ALL"),
    ("fft_real", lambda s, a: fourier.fft(a).map(lambda z: z["re"]), "SELECT m.i0, CAST(k AS BIGINT) AS i1, $V(sum(v * cos(2 * pi() * k * i1 / 12)))V$ AS v FROM m, range(12) g(k) GROUP BY ALL"),
    ("ifft_round_trip", lambda s, a: fourier.ifft(fourier.fft(a)).map(lambda z: z["re"]), "SELECT i0, i1, $V(v)V$ AS v FROM m"),
    ("irfft_round_trip", lambda s, a: fourier.irfft(fourier.rfft(a)), "SELECT i0, i1, $V(v)V$ AS v FROM m"),
    ("fft2_round_trip", lambda s, a: fourier.ifft2(fourier.fft2(a)).map(lambda z: z["re"]), "SELECT i0, i1, $V(v)V$ AS v FROM m"),
    ("inv_round_trip", lambda s, a: linalg.matmul(linalg.inv(_spd(s, a)), _spd(s, a)), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, (a.i = b.i)::INT::DOUBLE AS v FROM range(12) a(i), range(12) b(i)"),
    ("cholesky_round_trip", lambda s, a: linalg.matmul(linalg.cholesky(_spd(s, a)), shape.transpose(linalg.cholesky(_spd(s, a)))), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, CASE WHEN a.i = b.i THEN 13.0 ELSE 1.0 END::DOUBLE AS v FROM range(12) a(i), range(12) b(i)"),
    ("det", lambda s, a: linalg.det(shape.eye(s, 4).map(lambda v: v * 3)), "SELECT 81.0::DOUBLE AS v"),
    ("eigvalsh", lambda s, a: linalg.eigvalsh(_spd(s, a)), "SELECT CAST(i AS BIGINT) AS i0, CASE WHEN i = 11 THEN 24.0 ELSE 12.0 END::DOUBLE AS v FROM range(12) g(i)"),
    ("svdvals", lambda s, a: linalg.svdvals(_spd(s, a)), "SELECT CAST(i AS BIGINT) AS i0, CASE WHEN i = 0 THEN 24.0 ELSE 12.0 END::DOUBLE AS v FROM range(12) g(i)"),
    ("matrix_rank", lambda s, a: linalg.matrix_rank(_spd(s, a)), "SELECT 12.0::DOUBLE AS v"),
    ("matrix_power", lambda s, a: linalg.matrix_power(shape.eye(s, 3).map(lambda v: v * 2), 5), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, CASE WHEN a.i = b.i THEN 32.0 ELSE 0.0 END::DOUBLE AS v FROM range(3) a(i), range(3) b(i)"),
    ("solve", lambda s, a: linalg.solve(_spd(s, a), shape.ones(s, 12)), "SELECT CAST(i AS BIGINT) AS i0, round(1.0 / 24, 3) + 0.0 AS v FROM range(12) g(i)"),
    ("arange", lambda s, a: shape.arange(s, 2, 20, 3), "SELECT CAST(i AS BIGINT) AS i0, 2.0 + 3 * i AS v FROM range(6) g(i)"),
    ("linspace", lambda s, a: shape.linspace(s, 0, 1, 11), "SELECT CAST(i AS BIGINT) AS i0, $V(i / 10.0)V$ AS v FROM range(11) g(i)"),
    ("logspace", lambda s, a: shape.logspace(s, 0, 2, 5), "SELECT CAST(i AS BIGINT) AS i0, $V(pow(10.0, i / 2.0))V$ AS v FROM range(5) g(i)"),
    ("geomspace", lambda s, a: shape.geomspace(s, 1, 256, 9), "SELECT CAST(i AS BIGINT) AS i0, $V(pow(2.0, i))V$ AS v FROM range(9) g(i)"),
    ("eye", lambda s, a: shape.eye(s, 4), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, (a.i = b.i)::INT::DOUBLE AS v FROM range(4) a(i), range(4) b(i)"),
    ("tri", lambda s, a: shape.tri(s, 3, 4), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, (b.i <= a.i)::INT::DOUBLE AS v FROM range(3) a(i), range(4) b(i)"),
    ("diagflat", lambda s, a: shape.diagflat(shape.arange(s, 3), 1), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, CASE WHEN b.i = a.i + 1 THEN a.i::DOUBLE ELSE 0.0 END AS v FROM range(4) a(i), range(4) b(i)"),
    ("indices", lambda s, a: shape.indices(s, (2, 3)), "SELECT CAST(k AS BIGINT) AS i0, CAST(a.i AS BIGINT) AS i1, CAST(b.i AS BIGINT) AS i2, CASE k WHEN 0 THEN a.i ELSE b.i END::DOUBLE AS v FROM range(2) g(k), range(2) a(i), range(3) b(i)"),
    ("meshgrid", lambda s, a: shape.meshgrid(shape.arange(s, 3), shape.arange(s, 2))[1], "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, a.i::DOUBLE AS v FROM range(2) a(i), range(3) b(i)"),
    ("tril_indices", lambda s, a: shape.tril_indices(s, 4), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1 FROM range(4) a(i), range(4) b(i) WHERE b.i <= a.i"),
    ("triu_indices", lambda s, a: shape.triu_indices(s, 4), "SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1 FROM range(4) a(i), range(4) b(i) WHERE b.i >= a.i"),
    ("hanning", lambda s, a: shape.hanning(s, 9), "SELECT CAST(i AS BIGINT) AS i0, $V(0.5 - 0.5 * cos(2 * pi() * i / 8))V$ AS v FROM range(9) g(i)"),
    ("hamming", lambda s, a: shape.hamming(s, 9), "SELECT CAST(i AS BIGINT) AS i0, $V(0.54 - 0.46 * cos(2 * pi() * i / 8))V$ AS v FROM range(9) g(i)"),
    ("blackman", lambda s, a: shape.blackman(s, 9), "SELECT CAST(i AS BIGINT) AS i0, $V(0.42 - 0.5 * cos(2 * pi() * i / 8) + 0.08 * cos(4 * pi() * i / 8))V$ AS v FROM range(9) g(i)"),
    ("bartlett", lambda s, a: shape.bartlett(s, 9), "SELECT CAST(i AS BIGINT) AS i0, 1 - abs(i - 4.0::DOUBLE) / 4 AS v FROM range(9) g(i)"),
    ("fftfreq", lambda s, a: fourier.fftfreq(s, 8), "SELECT CAST(i AS BIGINT) AS i0, $V(CASE WHEN i < 4 THEN i ELSE i - 8 END / 8.0)V$ AS v FROM range(8) g(i)"),
    ("rfftfreq", lambda s, a: fourier.rfftfreq(s, 8), "SELECT CAST(i AS BIGINT) AS i0, $V(i / 8.0)V$ AS v FROM range(5) g(i)"),
):
    # means and products of the three-place cells end in ties at three places
    _register(_name, _build, _sql, 6 if _name in ("axis_mean", "convolve", "gradient", "trapezoid", "fft_real") else 3)


def _spd(s: SparkSession, a: Array) -> Array:
    """12 I + 1: a positive definite matrix."""
    return shape.eye(s, 12).map(lambda v: v * 12 + 1)


