"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all of
    Spark runs on this machine (local tests), a folder of it is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what is computed from the result never runs ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a table that joins shuffle, however small it is believed to be.

    What Python makes counts in a plan as no larger than what it was made from, so a
    join would send a whole matrix through the driver.
    """
    return df.hint("merge")


#: Bytes up to which a side of a join, of known size, is sent to every task.
SENT = 8 << 20


def sent(df: DataFrame, size: int) -> DataFrame:
    """A side of a join of ``size`` bytes: sent to every task if that is small, else shuffled."""
    return F.broadcast(df) if size <= SENT else dealt(df)


class Alternating:
    """The table of an iteration, kept in two places of the shared folder by turns.

    What is put may read what was put last, and replaces what was put before that:
    a long iteration keeps two copies. Only the table put last may be read later on.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.turn = spark, 0
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, by: str | None = None, rows: int = 0) -> DataFrame:
        """``by`` gives each value of a column a folder of its own; ``rows`` bounds those of a file, and so what a reader holds."""
        at, self.turn = f"{self.path}-{self.turn}", 1 - self.turn
        if by or rows:
            parted(df, at, by, rows)
        else:
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


def parted(df: DataFrame, path: str, by: str | None = None, rows: int = 0) -> None:
    """Write rows of packed arrays; the shuffles that made them are freed, as steps would pile them up."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(name, "false")
    conf.set(name, "true")
    try:
        writer = df.write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", rows)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        conf.set(name, was)
