"""Intermediate tables and Arrow batches of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_path as fresh_path

#: Arrow batches of texts hold at most so many bytes.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches of long texts be small: a task holds several copies of one, in the JVM and in Python.

    A smaller setting of the user's stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one job in the shared folder, removed once what follows is written.

    A name holds one table; saving under it again writes the new table first and then removes the old.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job = spark, job
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, f"{self.job}-{name}")
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))
