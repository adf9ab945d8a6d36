"""Writers for datasets, records, comparisons, manifests and histories.

Spark's commit protocol makes each appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import plain_base64, set_digests


def number_text(x: Column) -> Column:
    """An integer without decimals, any other by the fewest digits that read back as the same number
    (17 at most)."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def write_dataset(df: DataFrame, path: str, features: list[str], label: str = "label", order: list[Column] | None = None) -> None:
    rows = df.select(*[number_text(F.col(f)).alias(f) for f in features], F.col(label))
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").csv(path, header=True)


def reserved_records(df: DataFrame) -> DataFrame:
    """Reserved records of (record_id, content_sha256, label, sequence, request columns, raw)."""
    target = F.col("target")
    before = F.substring_index(target, "#", 1)
    path = F.regexp_replace(F.substring_index(before, "?", 1), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    query = F.when(F.contains(before, F.lit("?")), F.substr(before, F.instr(before, "?") + 1)).otherwise("")
    kind = F.try_element_at(F.try_element_at("headers", F.lit("content-type")), F.lit(1))
    return df.select(
        F.lit(1).alias("schema_version"), "record_id", "content_sha256", "label", F.col("sequence").alias("source_sequence"), "method", "target", F.col("version").alias("http_version"),
        F.when(path == "", "/").otherwise(path).alias("path"), query.alias("query"), "headers", kind.alias("content_type"), plain_base64(F.col("body")).alias("body_base64"), plain_base64(F.col("raw")).alias("raw_request_base64"),
    )


def write_records(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in source order (sorted by range, so parts are in order too)."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def control_records(df: DataFrame) -> DataFrame:
    return df.select("record_id", "content_sha256", "label", "partition", F.col("sequence").alias("source_sequence"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def manifest(df: DataFrame) -> DataFrame:
    """One JSON row: counts of each partition and label, digests of ids, and that partitions are
    disjoint. (Digests hold the ids of a partition; large ones belong in ``partition.overlap``.)"""
    parts = df.groupBy("partition").agg(F.count("*").alias("records"), F.count_if(F.col("label") == 1).alias("attacks"))
    parts = parts.join(set_digests(df, ["partition"], "record_id").withColumnRenamed("digest", "ids_sha256"), "partition")
    both = df.groupBy("record_id").agg(F.count_distinct("partition").alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("disjoint"))
    told = parts.agg(F.array_sort(F.collect_list(F.struct("partition", "records", "attacks", "ids_sha256"))).alias("partitions"), F.sum("records").alias("records"))
    return told.join(both, F.lit(True)).select(F.to_json(F.struct("records", "partitions", "disjoint")).alias("manifest"))


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def clear_history(spark, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").csv(path, header=True)


def archive(df: DataFrame, path: str, version: str) -> None:
    """Add a version as a partition; one that is there is replaced, the others stay."""
    rows = df.withColumn("version", F.lit(version)).write.mode("overwrite")
    rows.option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def stamp(at: Column) -> Column:
    """The name of an archive version: its instant to the second."""
    return F.date_format(at, "yyyyMMdd-HHmmss")


def write_split(df: DataFrame, path: str, index: str = "idx") -> None:
    df.select(index, "split").write.mode("overwrite").parquet(path)
