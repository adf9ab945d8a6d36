"""An index of the records of JSON-lines files: where each id's line is.

The index is sorted by id, so that a look-up reads the row group whose statistics hold it; a record
is then read by its byte range alone. What an index says of a file that has changed since is refused."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

#: Columns of an index; offset and length are bytes of the line, its line end not counted.
INDEX = "id string, path string, offset bigint, length bigint, file_size bigint, modified bigint"


def _files(spark: SparkSession, path: str) -> DataFrame:
    m = F.col("_metadata")
    return spark.read.format("binaryFile").load(path).select(m["file_path"].alias("path"), m["file_size"].alias("file_size"), F.unix_millis(m["file_modification_time"]).alias("modified"))


def entries(spark: SparkSession, path: str, key: str = "record_id") -> DataFrame:
    """``INDEX`` of every line under ``path`` that has the key. Byte ranges of a file are read apart: a
    range's lines are numbered from its start, and starts are sums over the ranges before."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, offset = None, 0
        for batch in batches:
            files, blocks, sizes = (batch.column(i).to_pylist() for i in (0, 1, 3))
            out = []
            for own, size in zip(zip(files, blocks, strict=True), sizes, strict=True):
                if own != at:
                    at, offset = own, 0
                out.append(offset)
                offset += size + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["file", "block", "id", "length", "offset"])

    # The path of each line as a hash, told apart from all others of the folder.
    listed = _files(spark, path).withColumn("file", F.xxhash64("path"))
    if not listed.groupBy("file").count().where("count > 1").isEmpty():
        raise ValueError("two paths have one hash")
    lines = spark.read.option("lineSep", "\n").text(path)
    rows = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.get_json_object("value", f"$.{key}").alias("id"), F.octet_length("value").cast("bigint").alias("length"),
    )
    found = written(rows.mapInArrow(placed, "file bigint, block bigint, id string, length bigint, offset bigint"))
    starts = found.groupBy("file", "block").agg(F.max(F.col("offset") + F.col("length") + 1).alias("n"))
    starts = starts.select("file", "block", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    both = found.where("id is not null").join(starts, ["file", "block"]).join(listed, "file")
    return both.select("id", "path", (F.col("start") + F.col("offset")).alias("offset"), "length", "file_size", "modified")


def write_index(spark: SparkSession, path: str, index: str, key: str = "record_id", group_rows: int = 100_000) -> None:
    """Write the index of the lines under ``path``: parts and the row groups in them hold ranges of ids."""
    rows = entries(spark, path, key).repartitionByRange("id").sortWithinPartitions("id")
    rows.write.option("parquet.block.row.count.limit", group_rows).mode("overwrite").parquet(index)


def look_up(spark: SparkSession, index: str, ids: list[str], schema: str, key: str = "record_id") -> tuple[DataFrame, int]:
    """(records of these ids, bytes that were read of the files). A few ids at a time: each is a seek.

    An error if an id isn't indexed, or its file is not of the size and time it was indexed at."""
    rows = spark.read.schema(INDEX).parquet(index).where(F.col("id").isin(*ids)).collect()
    if lacks := set(ids) - {r["id"] for r in rows}:
        raise KeyError(f"no record {sorted(lacks)[0]}")
    lines, n = [], 0
    for r in sorted(rows, key=lambda r: (r["id"], r["path"], r["offset"])):
        raw = _bytes(spark, *(r[c] for c in ("path", "offset", "length", "file_size", "modified")))
        n += len(raw)
        if json.loads(raw).get(key) != r["id"]:
            raise ValueError(f"the index doesn't fit {r['path']}")
        lines.append((raw.decode(),))
    told = spark.createDataFrame(lines, "value string").select(F.from_json("value", T._parse_datatype_string(schema)).alias("r"))
    return told.select("r.*"), n


def _bytes(spark: SparkSession, path: str, offset: int, length: int, size: int, modified: int) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    now = files.getFileStatus(at)
    if (now.getLen(), now.getModificationTime()) != (size, modified):
        raise ValueError(f"the index is older than {path}")
    stream = files.open(at)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()
