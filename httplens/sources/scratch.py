"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_written: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the one that ``spark.checkpoint.dir`` names, which executors share; without
    it in the warehouse, or, with a local master only (tests), on this machine."""
    global _local
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        if _local is None:
            _local = tempfile.mkdtemp(prefix="httplens-files-")
            atexit.register(shutil.rmtree, _local, True)
        base = f"file://{_local}"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read again: what follows reads it as often as it likes, and
    a lost executor costs a re-read. The folder goes when the application ends, or with ``release_all``."""
    path = scratch(df.sparkSession)
    if not _written:
        atexit.register(_at_end)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_all(spark: SparkSession) -> None:
    """Delete what ``written`` wrote in this process: for when results have been read."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _at_end() -> None:
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
        release_all(spark)
