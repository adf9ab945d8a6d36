"""Written tables that cut lineage.

Intermediate results go to the shared folder named by ``spark.checkpoint.dir``, as Parquet, so
that a lost executor costs a re-read and not a re-computation, and so that no plan is evaluated
twice. Where that setting is missing they go to the warehouse, which is shared as well, or, with a
local master only (tests), to a folder of this machine.

Tables that an operator needs no more are deleted at once (``release``, ``scoped``). Those that its
result still reads stay until ``release_all``, which also runs when the application ends."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None
_written: set[str] = set()
_inner: ContextVar[list[str] | None] = ContextVar("_inner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
    if _local is None:
        _local = tempfile.mkdtemp(prefix="httplens-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


#: Drops a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, *more: DataFrame) -> DataFrame:
    """``df`` written once and read again. The shuffle files of the write go when it has ended. More
    frames of the same columns are added one after the other, so that disk holds the shuffle files of one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_end)
    _written.add(path)
    if (inner := _inner.get()) is not None:
        inner.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextlib.contextmanager
def scoped(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside is deleted at the end, but for the frames given to the function that
    this yields: ``with scoped(spark) as keep: out = keep(staged(...))``."""
    outer, kept = _inner.get(), set()
    token = _inner.set([])

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    try:
        yield keep
    finally:
        mine = _inner.get()
        _inner.reset(token)
        for path in mine:
            if path in kept and outer is not None:
                outer.append(path)
            elif path not in kept and path in _written:
                _delete(spark, path)


def release(*frames: DataFrame) -> None:
    """Delete what ``staged`` wrote, once nothing that is still to run reads it."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all that ``staged`` wrote in this process: for when results have been written."""
    for path in list(_written):
        _delete(spark, path)


def _at_end() -> None:
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
        release_all(spark)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _written.discard(path)


def ordered_key(df: DataFrame, id_col: str, name: str, nulls: int) -> DataFrame:
    """``df`` with a bigint ``name`` in the order of the id: the id itself, if it is an integer,
    otherwise its number among the sorted distinct ids (numbers grow with gaps). Null ids get ``nulls``."""
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.withColumn(name, F.coalesce(F.col(id_col).cast("bigint"), F.lit(nulls)))
    ids = df.select(F.col(id_col).alias("__of")).where("__of is not null").distinct().sort("__of")
    ids = staged(ids.select("__of", F.monotonically_increasing_id().alias(name)))
    return df.join(ids, df[id_col] == ids["__of"], "left").drop("__of").withColumn(name, F.coalesce(F.col(name), F.lit(nulls)))
