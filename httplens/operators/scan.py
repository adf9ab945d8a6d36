"""Prefix scans of series of any length: a series is split into ranges, each range is scanned by
itself, and what a range takes over from those before it is carried over a short table of ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

RANGE = "__range"


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the number of its range: parts of the rows in order of ``by`` and ``order``, of about equal
    size, whatever the keys. Written, as ranges are drawn anew in each run."""
    return written(df.repartitionByRange(*by, *order).withColumn(RANGE, F.spark_partition_id()))


def _joined(rows: DataFrame, told: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each row with what its range is told; null keys are keys."""
    same = F.lit(True)
    for n, c in enumerate(on):
        told = told.withColumnRenamed(c, f"__k{n}")
        same = same & F.col(c).eqNullSafe(F.col(f"__k{n}"))
    return rows.join(told, same).drop(*[f"__k{n}" for n in range(len(on))])


def scan(
    df: DataFrame, by: Sequence[str], order: Sequence[str], number: str | None = None, total: str | None = None, previous: dict[str, str] | None = None, least: dict[str, str] | None = None, sums: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with columns told by the rows up to each in its series (``by``; one series without it) in
    ``order``: ``number`` from 1, ``total`` of the series, ``previous`` (column to name: its value in
    the row before), ``least`` and ``sums`` (column to name: the smallest value so far, and their sum).

    A task scans a range of a series; the table over which ranges are joined up has a row for each
    range of each series. Rows of equal order may stand in any order."""
    previous, least, sums = previous or {}, least or {}, sums or {}
    rows, key = ranged(df, by, order), [*by, RANGE]
    inside = W.partitionBy(*key).orderBy(*order)
    own = [F.row_number().over(inside).alias("__i")]
    own += [F.lag(F.struct(F.col(c).alias("v"))).over(inside).alias(f"__p{n}") for n, c in enumerate(previous)]
    own += [F.min(c).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"__m{n}") for n, c in enumerate(least)]
    own += [F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"__t{n}") for n, c in enumerate(sums)]
    last = F.struct(*order)
    ranges = rows.groupBy(*key).agg(
        F.count("*").alias("__n"), *[F.max_by(F.struct(F.col(c).alias("v")), last).alias(f"__l{n}") for n, c in enumerate(previous)], *[F.min(c).alias(f"__s{n}") for n, c in enumerate(least)],
        *[F.sum(c).alias(f"__u{n}") for n, c in enumerate(sums)],
    )
    series = W.partitionBy(*by)
    before = series.orderBy(RANGE)
    upto = before.rowsBetween(W.unboundedPreceding, -1)
    carried = ranges.select(
        *key, F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(series).alias("__total"),
        *[F.lag(f"__l{n}").over(before).alias(f"__l{n}") for n in range(len(previous))], *[F.min(f"__s{n}").over(upto).alias(f"__s{n}") for n in range(len(least))],
        *[F.sum(f"__u{n}").over(upto).alias(f"__u{n}") for n in range(len(sums))],
    )
    both = _joined(rows.select("*", *own), carried, key)
    out: list[Column] = [both[c] for c in df.columns]
    if number:
        out.append((F.col("__before") + F.col("__i")).alias(number))
    if total:
        out.append(F.col("__total").alias(total))
    out += [F.coalesce(f"__p{n}", f"__l{n}")["v"].alias(name) for n, name in enumerate(previous.values())]
    out += [F.least(f"__m{n}", f"__s{n}").alias(name) for n, name in enumerate(least.values())]
    out += [(F.coalesce(f"__t{n}", F.lit(0)) + F.coalesce(f"__u{n}", F.lit(0))).alias(name) for n, name in enumerate(sums.values())]
    return both.select(*out)


def _then(first: tuple, second: tuple) -> tuple:
    """Two clamp-and-add maps one after the other: x to min(high, max(low, x + add))."""
    (a1, l1, h1), (a2, l2, h2) = first, second
    clamp = lambda x: np.minimum(h2, np.maximum(l2, x))
    return a1 + a2, clamp(l1 + a2), clamp(h1 + a2)


def clamped_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], add: str, low: str, high: str, start: float, name: str) -> DataFrame:
    """``df`` with x after each row of its series: x becomes min(high, max(low, x + add)), from ``start``
    on. Such maps are closed under composition, so ranges are composed apart, then joined up. The rows
    of a range stream in order, and what a task holds is a batch of them, whatever the range's size."""
    parts = ["__a", "__l", "__h"]
    rows = ranged(df.withColumns(dict(zip(parts, (F.col(c).cast("double") for c in (add, low, high)), strict=True))), by, order)
    key = [*by, RANGE]

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whole, n = None, None, 0  # the range so far: its map and rows
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            given = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in parts]
            out, at = [np.empty(len(keys)) for _ in parts], np.empty(len(keys), np.int64)
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                maps, step = tuple(x[lo:hi] for x in given), 1
                while step < hi - lo:  # each map so far is of ``step`` rows at most
                    longer = _then(tuple(x[:-step] for x in maps), tuple(x[step:] for x in maps))
                    maps = tuple(np.r_[x[:step], y] for x, y in zip(maps, longer, strict=True))
                    step *= 2
                if whole is not None and keys[lo] == last:
                    maps = _then(whole, maps)
                else:
                    n = 0
                for x, y in zip(out, maps, strict=True):
                    x[lo:hi] = y
                at[lo:hi] = np.arange(n, n + hi - lo)
                last, whole, n = keys[lo], tuple(x[-1] for x in maps), n + hi - lo
            cols = dict(zip(batch.schema.names, batch.columns, strict=True)) | dict(zip(parts, map(pa.array, out), strict=True)) | {"__i": pa.array(at)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = T.StructType([*rows.schema.fields, T.StructField("__i", T.LongType())])
    done = written(rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(composed, schema))
    whole = done.groupBy(*key).agg(F.max_by(F.struct(*parts), "__i").alias("w")).select(*key, *[F.col(f"w.{c}").alias(c) for c in parts])

    def carried(f: pd.DataFrame) -> pd.DataFrame:
        f, x, begin = f.sort_values(RANGE), start, []
        for a, lo, hi in zip(*(f[c] for c in parts), strict=True):
            begin.append(x)
            x = min(hi, max(lo, x + a))
        return f.assign(__x=begin)[[*key, "__x"]]

    kinds = ", ".join(f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in key)
    begun = whole.groupBy(*by).applyInPandas(carried, f"{kinds}, __x double")
    both = _joined(done, begun, key)
    return both.select(*[both[c] for c in df.columns], F.least("__h", F.greatest("__l", F.col("__x") + F.col("__a"))).alias(name))
