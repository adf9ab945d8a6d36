"""Hashes of records and sets, equal to what a byte-wise implementation gives."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch, written

# Fixed value: the domain that separates record ids from other hashes.
DOMAIN = b"csic-experimento-2"


def big_endian(n: Column) -> Column:
    """An integer as eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def record_id(dataset: Column, sequence: Column, raw: Column) -> Column:
    zero = F.lit(b"\x00")
    return F.sha2(F.concat(F.lit(DOMAIN), zero, F.encode(dataset, "US-ASCII"), zero, big_endian(sequence), zero, raw), 256)


def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def selection_key(seed: int, dataset: Column, sequence: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), dataset, sequence.cast("string"), content), 256)


def set_digest(ids: Column) -> Column:
    """Aggregate: SHA-256 of the distinct ids in order, each followed by a line end. All ids of a group
    meet in one row: for small sets (see ``set_digests``)."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), F.lit("\n")), 256)


def index_digest(indices: Column) -> Column:
    """Aggregate: SHA-256 of the sorted indices as big-endian 64-bit integers, for small sets (see
    ``index_digests``)."""
    words = F.transform(F.array_sort(F.collect_list(indices)), lambda i: F.lpad(F.hex(i), 16, "0"))
    return F.sha2(F.unhex(F.array_join(words, "")), 256)


#: Rows of a group that one task sorts (larger ones are sorted by ranges), and bytes of a chunk.
LARGE, CHUNK = 1 << 20, 1 << 12


def _in_order(df: DataFrame) -> DataFrame:
    """``df`` in one partition that streams through the former ones, as written, one after the other."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint().coalesce(1)


def _digests(df: DataFrame, by: list[str], id_col: Column, told: Callable[[list], bytes], once: bool, large: int) -> DataFrame:
    """(by, digest): SHA-256 of what ``told`` says of all ids of each group in order, equal ids once if
    ``once``. A digest can't be told in parts, but the rows of a group stream through it, and only its
    state is kept. Groups of more than ``large`` rows are sorted by ranges in many tasks, and the
    sorted ranges are written and then read in turn: no task's memory grows with a group."""
    rows = df.select(*by, id_col.alias("__id")).where("__id is not null")
    key = rows.select(*by).schema.fields

    def run(batches: Iterator[pa.RecordBatch], give: Callable, take: Callable) -> Iterator[pa.RecordBatch]:
        at, last, state = None, None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if state is None or keys[lo] != last:
                    if state is not None:
                        yield from give(at, state, True)
                    at, last, state = batch.select(by).slice(lo, 1), keys[lo], take(None, None)
                state = take(state, batch.column(len(by)).slice(lo, hi - lo).to_pylist())
                yield from give(at, state, False)
        if state is not None:
            yield from give(at, state, True)

    def raw(state: list | None, ids: list | None) -> list:
        """[the last id, bytes not yet given]"""
        if state is None:
            return [None, bytearray()]
        before, state[0] = state[0], ids[-1]
        state[1] += told([x for x, y in zip(ids, [before, *ids], strict=False) if x != y] if once else ids)
        return state

    def hashed(state: list | None, ids: list | None) -> list:
        state = raw(state[:2] if state else None, ids) + (state[2:] if state else [hashlib.sha256()])
        state[2].update(state[1])
        state[1].clear()
        return state

    def chunks(at: pa.RecordBatch, state: list, end: bool) -> Iterator[pa.RecordBatch]:
        n = len(state[1]) if end else len(state[1]) // CHUNK * CHUNK
        if n:
            out = [bytes(state[1][i : min(i + CHUNK, n)]) for i in range(0, n, CHUNK)]
            del state[1][:n]
            whole = pa.Table.from_batches([at]).take(pa.array([0] * len(out))).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(out, pa.binary())], names=[*by, "__chunk"])

    def added(state: list | None, parts: list | None) -> list:
        state = state or [None, b"", hashlib.sha256()]
        for part in parts or ():
            state[2].update(part)
        return state

    def digest(at: pa.RecordBatch, state: list, end: bool) -> Iterator[pa.RecordBatch]:
        if end:
            yield pa.RecordBatch.from_arrays([*at.columns, pa.array([state[2].hexdigest()])], names=[*by, "digest"])

    out = T.StructType([*key, T.StructField("digest", T.StringType())])
    few = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > large).select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(by)])
    few = written(few)  # a row for each group of more than ``large`` rows
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{n}")) for n, c in enumerate(by)])
    none = few.isEmpty()
    small = rows if none else rows.join(F.broadcast(few), same, "left_anti")
    small = small.repartition(*by).sortWithinPartitions(*by, "__id").mapInArrow(lambda b: run(b, digest, hashed), out)
    if none:
        return small
    big = rows.join(F.broadcast(few), same, "left_semi").repartitionByRange(*by, "__id").sortWithinPartitions(*by, "__id")
    big = big.mapInArrow(lambda b: run(b, chunks, raw), T.StructType([*key, T.StructField("__chunk", T.BinaryType())]))
    return small.union(_in_order(big).mapInArrow(lambda b: run(b, digest, added), out))


def set_digests(df: DataFrame, by: list[str], id_col: str, large: int = LARGE) -> DataFrame:
    """(by, digest): ``set_digest`` of each group, for sets of any size."""
    told = lambda ids: "".join([f"{x}\n" for x in ids]).encode()
    return _digests(df, by, F.col(id_col).cast("string"), told, True, large)


def index_digests(df: DataFrame, by: list[str], index_col: str, large: int = LARGE) -> DataFrame:
    """(by, digest): SHA-256 of each group's sorted indices as big-endian 64-bit integers."""
    told = lambda ids: np.array(ids, ">i8").tobytes()
    return _digests(df, by, F.col(index_col).cast("bigint"), told, False, large)


def bucketed_digest(df: DataFrame, by: list[str], id_col: str, digits: int = 3) -> DataFrame:
    """(by, digest) for sets of any size, whose plain digest would need all ids in one row: the digest
    of the digests of buckets, by the first hexadecimal digits of the ids' SHA-256, in order."""
    bucket = F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, digits).alias("__bucket")
    each = df.groupBy(*by, bucket).agg(set_digest(F.col(id_col).cast("string")).alias("__digest"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("__bucket", "__digest"))), lambda x: F.concat(x["__bucket"], F.lit(":"), x["__digest"]))
    return each.groupBy(*by).agg(F.sha2(F.array_join(told, "\n"), 256).alias("digest"))


def plain_base64(raw: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(raw), "[\r\n]", "")
