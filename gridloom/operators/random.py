"""Random arrays, made in parallel and alike on every run.

Values come in blocks of ``BLOCK`` with a generator seeded by (seed, call, block), so
they depend neither on partitioning nor on tasks that run again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..arrays import Array, axis_name, number_rows, unravel
from ..storage import dealt
from .shape import take

BLOCK = 1 << 16

#: The distributions of the generator with their parameters in order.
DISTRIBUTIONS = (
    "beta", "binomial", "chisquare", "exponential", "f", "gamma", "gumbel", "hypergeometric", "laplace", "logistic", "lognormal",
    "logseries", "negative_binomial", "noncentral_chisquare", "noncentral_f", "normal", "pareto", "poisson", "power", "rayleigh",
    "standard_cauchy", "standard_exponential", "standard_gamma", "standard_normal", "standard_t", "triangular", "uniform", "vonmises",
    "wald", "weibull", "zipf",
)
#: Those whose values are integers.
WHOLE = frozenset("binomial geometric hypergeometric integers logseries negative_binomial poisson zipf".split())
#: Those with a vector for each draw.
VECTORS = ("dirichlet", "multinomial", "multivariate_hypergeometric", "multivariate_normal")


class Generator:
    """Draws of many distributions: ``generator.normal(0.0, 1.0, size=(1000, 10))``."""

    def __init__(self, spark: SparkSession, seed: int = 0) -> None:
        self.spark, self.seed, self.calls = spark, seed, 0

    def _draw(self, f: Callable[[np.random.Generator, int], np.ndarray], size: int | Sequence[int], whole: bool = False, wide: int = 0) -> Array:
        shape = (size,) if isinstance(size, int) else tuple(size)
        n, seed, call = math.prod(shape), self.seed, self.calls
        self.calls += 1
        kind = pa.int64() if whole else pa.float64()
        schema = pa.schema([("flat", pa.int64()), ("v", pa.list_(kind) if wide else kind)])
        ddl = f"flat bigint, v {'array<' * bool(wide)}{'bigint' if whole else 'double'}{'>' * bool(wide)}"

        def run(batches):
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    count = min(BLOCK, n - block * BLOCK)
                    rng = np.random.Generator(np.random.PCG64DXSM([seed, call, block]))
                    values = np.asarray(f(rng, count))
                    if wide:
                        offsets = np.arange(0, (count + 1) * wide, wide, dtype=np.int32)
                        v = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)).cast(kind))
                    else:
                        v = pa.array(values).cast(kind)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(count) + block * BLOCK), v], schema=schema)

        df = dealt(self.spark.range(-(-n // BLOCK)).mapInArrow(run, ddl))
        if wide:
            df, shape = df.select("flat", F.posexplode("v").alias("__k", "v")), (*shape, wide)
            df = df.select((F.col("flat") * wide + F.col("__k")).alias("flat"), "v")
        return Array(df.select(*(c.alias(axis_name(k)) for k, c in enumerate(unravel(F.col("flat"), shape))), "v"), shape)

    def random(self, size: int | Sequence[int] = 1) -> Array:
        return self._draw(lambda rng, n: rng.random(n), size)

    def integers(self, low: int, high: int | None = None, size: int | Sequence[int] = 1, endpoint: bool = False) -> Array:
        return self._draw(lambda rng, n: rng.integers(low, high, n, endpoint=endpoint), size, whole=True)

    def geometric(self, p: float, size: int | Sequence[int] = 1) -> Array:
        """Failures before the first success, from 0."""
        return self._draw(lambda rng, n: rng.geometric(p, n) - 1, size, whole=True)

    def bytes(self, length: int) -> bytes:
        return np.random.default_rng([self.seed, self.calls]).bytes(length)

    def permutation(self, a: Array | int) -> Array:
        """A shuffled array (its first axis), or the shuffled numbers below n."""
        if isinstance(a, int):
            base = self.spark.range(a).select(F.col("id").alias("v"))
            keyed = base.withColumn("__key", F.xxhash64(F.lit(self.seed), F.lit(self.calls), "v"))
            self.calls += 1
            return Array(number_rows(keyed, ["__key", "v"], "i0").select("i0", "v"), (a,))
        return take(a, self.permutation(a.shape[0]), 0)

    shuffle = permutation

    def permuted(self, a: Array, axis: int) -> Array:
        """Every lane shuffled on its own."""
        from pyspark.sql import Window

        name = axis_name(a.axis(axis))
        key = F.xxhash64(F.lit(self.seed), F.lit(self.calls), *a.axes)
        self.calls += 1
        w = Window.partitionBy(*(x for x in a.axes if x != name)).orderBy(key, name)
        return Array(a.df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint")).select(*a.axes, "v"), a.shape)

    def choice(self, a: Array | int, size: int | Sequence[int] = 1, replace: bool = True, p: Sequence[float] | None = None) -> Array:
        n = a if isinstance(a, int) else a.shape[0]
        if not replace:
            order, count = self.permutation(n), size if isinstance(size, int) else math.prod(size)
            picked = Array(order.df.filter(F.col("i0") < count), (count,))
        else:
            picked = self._draw(lambda rng, m: rng.choice(n, m, p=p), size, whole=True)
        return picked if isinstance(a, int) else take(a, picked)

    def spawn(self, n: int) -> list[Generator]:
        return [Generator(self.spark, self.seed * 1_000_003 + 7919 * (k + 1)) for k in range(n)]

    def sample_rows(self, df: DataFrame, share: float) -> DataFrame:
        return df.sample(fraction=share, seed=self.seed)


def _method(name: str):
    def draw(self: Generator, *parameters: Any, size: int | Sequence[int] = 1) -> Array:
        return self._draw(lambda rng, n: getattr(rng, name)(*parameters, size=n), size, name in WHOLE)

    draw.__name__, draw.__doc__ = name, f"Draws of the {name.replace('_', ' ')} distribution."
    return draw


def _vector_method(name: str):
    def draw(self: Generator, *parameters: Any, size: int | Sequence[int] = 1) -> Array:
        wide = len(parameters[0] if name != "multinomial" else parameters[1])
        return self._draw(lambda rng, n: getattr(rng, name)(*parameters, size=n), size, name.startswith("multi") and not name.endswith("normal"), wide)

    draw.__name__, draw.__doc__ = name, f"Vectors of the {name.replace('_', ' ')} distribution along a last axis."
    return draw


for _name in DISTRIBUTIONS:
    setattr(Generator, _name, _method(_name))
for _name in VECTORS:
    setattr(Generator, _name, _vector_method(_name))


def default_rng(spark: SparkSession, seed: int = 0) -> Generator:
    return Generator(spark, seed)
