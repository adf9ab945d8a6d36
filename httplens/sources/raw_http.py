"""Raw HTTP messages: corpora of concatenated messages, and parsing of single ones.

Messages are told apart by ``framing``, in ranges of each file; parsing is then per row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.forms import safe_name
from ..functions.text import SPACE
from . import framing

#: Counters of the lenient scan.
COUNTERS = ("outside", "header_end", "folded", "bad_length", "truncated")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, content) of each file."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def scan(spark: SparkSession, path: str, dataset: str, chunk: int = framing.CHUNK) -> DataFrame:
    """(dataset, path, sequence, raw): strictly framed messages, in order from 0 in each file."""
    return framing.frame(spark, path, True, chunk).select(F.lit(dataset).alias("dataset"), "path", "sequence", "raw")


_REQUEST = {
    "method": pa.string(), "target": pa.string(), "version": pa.string(), "headers": pa.map_(pa.string(), pa.list_(pa.string())), "body": pa.binary(), "malformed": pa.list_(pa.string()),
    **{c: pa.int64() for c in COUNTERS[1:]},
}
_REQUEST_SCHEMA = "method string, target string, version string, headers map<string,array<string>>, body binary, malformed array<string>, " + ", ".join(f"{c} bigint" for c in COUNTERS[1:])


def _opened(raw: bytes | None) -> tuple:
    """Columns of a leniently framed message: the last Content-Length holds, folded lines are joined."""
    if raw is None:
        return (None,) * 6 + (0,) * 4
    stop = (raw.find(b"\n") + 1) or len(raw)
    text = [x.decode("latin-1") for x in framing.PARTS.match(raw, 0, stop).groups()]
    end = framing.end_of_head(raw, stop)
    found, malformed, folded = framing.fields(raw[stop : end[0]])
    names: dict[str, list[str]] = {}
    for name, value in found:
        names.setdefault(name, []).append(value)
    size, body = framing.body_size(names.get("content-length", [])), raw[end[1] :]
    return text[0].upper(), *text[1:], list(names.items()), body, malformed, int(end[0] == end[1]), folded, int(size < 0), int(len(body) < size)


def scan_lenient(spark: SparkSession, path: str, corpus: str, chunk: int = framing.CHUNK) -> DataFrame:
    """(corpus, path, seq, request columns, counters): as the lenient framing gives them. A row without
    a method carries the lines outside that follow a chunk's last message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(_opened, batch.column(2).to_pylist()), strict=True)) or [()] * len(_REQUEST)
            own = [pa.array(list(c), t) for c, t in zip(rows, _REQUEST.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *own], names=["path", "seq", "outside", *_REQUEST])

    framed = framing.frame(spark, path, False, chunk).select("path", F.col("sequence").alias("seq"), "raw", "outside")
    rows = framed.mapInArrow(run, f"path string, seq bigint, outside bigint, {_REQUEST_SCHEMA}")
    return rows.withColumns({"corpus": F.lit(corpus), "method": safe_name(F.col("method"), 40), "version": safe_name(F.col("version"), 30)})


def parser_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("corpus").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("method").alias("messages"))


def parsed(raw: Column) -> Column:
    """struct(method, target, version, headers, body) of one message, natively.

    The head ends at the first empty line (CRLF if there is such a one, else LF) and all that follows is
    the body. A message without a request line of three parts is an error."""
    text = F.decode(raw, "ISO-8859-1")
    crlf = F.instr(text, "\r\n\r\n")
    lf = F.instr(text, "\n\n")
    at = F.when(crlf > 0, crlf).when(lf > 0, lf)
    head = F.regexp_replace(F.when(at.isNotNull(), F.substr(text, F.lit(1), at - 1)).otherwise(text), "\r\n", "\n")
    body = F.when(at.isNotNull(), F.substr(raw, at + F.when(crlf > 0, 4).otherwise(2))).otherwise(F.lit(b""))
    trim = lambda c: F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")
    lines = F.split(head, "\n")
    first = trim(F.element_at(lines, 1))
    a, b = F.instr(first, " "), F.length(first) - F.length(F.substring_index(first, " ", -1))
    token = F.substring_index(first, " ", -1)
    ok = (a > 1) & (b > a)
    folded = F.regexp_replace(F.array_join(F.slice(lines, 2, 1 << 30), "\n"), r"\n[ \t]+", " ")
    fields = F.filter(F.split(folded, "\n"), lambda h: F.contains(h, F.lit(":")))
    pairs = F.transform(fields, lambda h: F.struct(F.lower(trim(F.substring_index(h, ":", 1))).alias("k"), trim(F.substr(h, F.instr(h, ":") + 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    headers = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]).alias("value"))))
    method = F.when(ok, F.upper(F.substr(first, F.lit(1), a - 1))).otherwise(F.raise_error(F.lit("not a request line")).cast("string"))
    version = F.when(F.upper(token).startswith("HTTP/"), F.substr(token, F.lit(6))).otherwise(token)
    return F.struct(method.alias("method"), F.substr(first, a + 1, b - a - 1).alias("target"), trim(version).alias("version"), headers.alias("headers"), body.alias("body"))


def requests(messages: DataFrame, keep: tuple[str, ...] = ("dataset", "sequence")) -> DataFrame:
    """Request columns of (keep, raw)."""
    return messages.select(*keep, parsed(F.col("raw")).alias("r")).select(*keep, "r.*")
