"""Tables in the shared folder, and small helpers that every operator uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no shared folder, as in tests.
OWN_ROOT = "/tmp/checkpoints/glotspark"
#: Spark's own bounds let a task hold 10,000 rows at once, on either side of the pipe to Python.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Off one machine its absence is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or OWN_ROOT).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/glotspark/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands Python batches of about 4 MB (or one row), unless it has a bound of its own. No result depends on it."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def crc_fold(column, n: int):
    """crc32 of the id written as text, modulo ``n`` (null id: null)."""
    return F.crc32(column.cast("string").cast("binary")) % n


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that this package wrote."""
    if "/glotspark/" not in path:
        raise ValueError(f"{path} isn't a table of this package")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables in the shared folder that go once the results that need them are tables themselves."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())
