"""All queries of the array engine, by name, with their SQL.

Element-wise functions are registered from tables of (Column, SQL) pairs over one
projection each; everything else is a small function with its SQL beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "reduce_by_group"


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, places: int) -> Column:
    """Rounding as arrays round: scaled, to a whole number, and back, without a decimal form between."""
    return F.round(value * 10.0**places) / 10.0**places


def number(value: Column) -> Column:
    """Doubles are compared to six places; adding 0.0 makes -0.0 plain."""
    return rounded(value, 6) + F.lit(0.0)


def projection(name: str, table: str, key: str, values: dict[str, str], column: Callable[[], Column], sql: str, kind: str = "double") -> None:
    """A query ``key, value`` of one Column function over named inputs of a table.

    ``values`` gives the inputs as SQL that Spark and DuckDB read alike.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = read(spark, sf_dir, table).selectExpr(key, *(f"{e} as {n}" for n, e in values.items()))
        out = column()
        return base.select(key, (number(out) if kind == "double" else out).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    inputs = ", ".join(f"{e} AS {n}" for n, e in values.items())
    value = f"round({sql}, 6) + 0.0" if kind == "double" else sql
    ORACLES[name] = f"SELECT {key}, {value} AS value FROM (SELECT {key}, {inputs} FROM {table})"


from . import arrays, elementwise, factors, groups, more, long, applied  # noqa: E402,F401  isort: skip  the last replace constructors alone
