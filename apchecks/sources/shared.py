"""The folder that driver and executors share, and tables that a session derives once and keeps there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths of derived tables by (application, source folder, name).
_KEPT: dict[tuple[str, str, str], tuple[str, object]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master (tests) gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back, which cuts its plan."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def derived_once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` derives from ``source``, written as Parquet at its first use in a session.

    Later uses read the files, so that checks that share a table neither derive it again nor shuffle for
    it, and get its columns and row groups pruned like any source's.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _KEPT:
        made, path = build(), shared_path(spark, name)
        made.write.parquet(path)
        _KEPT[key] = (path, made.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)
