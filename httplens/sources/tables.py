"""Typed readers for the files that analyses exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import FINAL
from ..operators.history import HISTORY

# The nine features of the small model, with their limits.
SMALL = {"is_post_put": 1.0, "query_length": 200.0, "body_length": 1000.0, "special_chars_query": 25.0, "special_chars_body": 40.0, "has_sql_keywords": 1.0, "has_xss_keywords": 1.0, "is_standard_browser": 1.0, "request_rate": 800.0}

LIVE = "id bigint, at timestamp, method string, target string, version string, headers map<string,array<string>>, body_base64 string"
CONTROL = "record_id string, content_sha256 string, label int, partition string, source_sequence bigint"
RESERVED = (
    "schema_version int, record_id string, content_sha256 string, label int, source_sequence bigint, method string, target string, http_version string, path string, query string, "
    "headers map<string,array<string>>, content_type string, body_base64 string, raw_request_base64 string"
)


def dataset(spark: SparkSession, path: str, features: tuple[str, ...] = FINAL, label: str = "label") -> DataFrame:
    """A CSV whose header is exactly features and label; malformed rows, values that aren't finite and
    labels other than 0 and 1 are errors."""
    schema = ", ".join(f"`{f}` double" for f in features) + f", `{label}` int"
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    bad = ~F.col(label).isin(0, 1) | F.col(label).isNull()
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    return rows.withColumn(label, F.when(bad, F.raise_error(F.lit("value not finite or label not 0 or 1")).cast("int")).otherwise(F.col(label)))


def small_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The headerless CSV of nine features and a label."""
    return spark.read.schema(", ".join(f"{c} double" for c in SMALL) + ", label int").csv(path, mode="FAILFAST")


def reserved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESERVED).json(path)


def live_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as they come: a stream of JSON lines in files that are added to a folder."""
    return spark.readStream.schema(LIVE).json(path)


def control(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTROL).json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).csv(path, header=True)


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """A series as text columns; ``sniffed`` gives their values."""
    return spark.read.csv(path, header=True)


def sniffed(value: Column) -> Column:
    """struct(integer, number, text): what a cell is; all null if empty."""
    text = F.when(value != "", value)
    n = text.try_cast("double")
    whole = F.when(n == F.floor(n), n.try_cast("bigint"))
    return F.struct(whole.alias("integer"), F.when(whole.isNull(), n).alias("number"), F.when(n.isNull(), text).alias("text"))


def artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def versions(spark: SparkSession, pattern: str) -> DataFrame:
    """Results of each archived version with the folder it lies in, by name."""
    rows = spark.read.json(pattern, multiLine=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select("*", F.element_at(parts, -3).alias("version")).orderBy("version")
