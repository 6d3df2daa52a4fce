"""Tables kept for the session in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000

_kept: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder where that is unset and driver and executors are one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.gettempdir()}/soundweave-checkpoints"
    return found.rstrip("/")


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at a path, which tell whether a table has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/index-{uuid.uuid4().hex}"


def kept(spark: SparkSession, name: tuple, make: Callable[[str], None]) -> str:
    """The path of what make has written, once an application for each name."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _kept:
        path = new_path(spark)
        make(path)
        _kept[key] = path
    return _kept[key]


def written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has most rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
