"""Deterministic partitions, stratified splits and the checks that hold them."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import content_hash, record_id, selection_key

SEED = 20260917


def identified(raw: DataFrame) -> DataFrame:
    """(dataset, sequence, raw, ...) with content_sha256 and record_id."""
    return raw.withColumns({"content_sha256": content_hash(F.col("raw")), "record_id": record_id(F.col("dataset"), F.col("sequence"), F.col("raw"))})


def select_top(df: DataFrame, quantity: int, dataset: str = "dataset", sequence: str = "sequence", content: str = "content_sha256", seed: int = SEED) -> DataFrame:
    """``df`` with ``partition``: development for the first ``quantity`` of each dataset by hash of
    seed, dataset, sequence and content, reserved for the rest.

    Only the key and the two identifying columns go through the ranking, and the engine keeps
    ``quantity`` rows of each task before it shuffles. Of what is chosen the last key and sequence of
    each dataset go on, a row for each, and every row is compared with those where it is: neither
    content nor rejected rows are sorted or shuffled. Rows of one dataset, sequence and content share
    a key and so a part."""
    key = selection_key(seed, F.col(dataset), F.col(sequence), F.col(content))
    order = W.partitionBy("__d").orderBy("__k", "__s")
    ranked = df.select(F.col(dataset).alias("__d"), F.col(sequence).alias("__s"), key.alias("__k")).withColumn("__n", F.row_number().over(order))
    last = ranked.where(F.col("__n") <= quantity).groupBy("__d").agg(F.max(F.struct("__k", "__s")).alias("__last"))
    marked = df.join(F.broadcast(last), df[dataset] == last["__d"], "left")
    chosen = F.struct(key.alias("__k"), F.col(sequence).alias("__s")) <= F.col("__last")
    return marked.withColumn("partition", F.when(chosen, "development").otherwise("reserved")).drop("__d", "__last")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both hold: empty for disjoint partitions."""
    return a.select(key).intersect(b.select(key))


def incomplete(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """Keys that the parts lack or have in excess of the whole, with multiplicity."""
    union = parts[0].select(key)
    for p in parts[1:]:
        union = union.unionAll(p.select(key))
    want = whole.select(key)
    return want.exceptAll(union).unionAll(union.exceptAll(want))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def multiplicities(df: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """(key, whole, and each of ``parts``): how many rows of each key there are, and in the rows that
    each condition takes. One grouping tells what ``overlap``, ``incomplete`` and ``repeated`` find."""
    return df.groupBy(key).agg(F.count("*").alias("whole"), *[F.count_if(c).alias(n) for n, c in parts.items()])


def mismatches(first: DataFrame, second: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Rows of two scans whose fields differ at the same place, or that one scan lacks."""
    a, b = first.select(*on, *[F.col(f).alias(f"{f}_1") for f in fields]), second.select(*on, *[F.col(f).alias(f"{f}_2") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"{f}_1").eqNullSafe(F.col(f"{f}_2"))
    return a.join(b, on, "full_outer").where(~same)


def schema_difference(df: DataFrame, expected: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns."""
    return sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))


def stratified(df: DataFrame, label: str, order: list[Column], train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``df`` with ``split`` (treino, validacao, teste) by rank within the label, cut at the whole
    parts of 70 % and 15 %, each a product in double precision as the reference has it (62 of 90 rows
    are for training: 90 * 0.7 is a little under 63); the rest is for the test.

    Ranks come from sums over hash buckets and a rank inside each, so a label of any size is
    spread over tasks. ``order`` must end in unique values for the split to be reproducible."""
    key = F.md5(F.concat_ws(":", *[c.cast("string") for c in order]))
    rows = df.withColumn("__h", key).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))
    w = W.partitionBy("__l")
    before = w.orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__l", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__all"))
    rows = rows.join(counts, rows[label].eqNullSafe(counts["__l"]) & (rows["__b"] == counts["__c"]))
    rank = F.col("__before") + F.row_number().over(W.partitionBy(label, "__b").orderBy("__h"))
    first = F.floor(F.col("__all") * F.lit(train))
    second = first + F.floor(F.col("__all") * F.lit(validation))
    split = F.when(rank <= first, "treino").when(rank <= second, "validacao").otherwise("teste")
    return rows.withColumn("split", split).drop("__h", "__b", "__l", "__c", "__before", "__all")


def reference_split(labels: np.ndarray, seed: int, train: float = 0.70, validation: float = 0.15) -> dict[str, np.ndarray]:
    """The split that a seeded generator of numpy gives, on the driver: for reproducing published
    index digests. Labels in order, then each part is shuffled once more by the same generator."""
    rng = np.random.default_rng(seed)
    names = ("treino", "validacao", "teste")
    parts: dict[str, list[np.ndarray]] = {n: [] for n in names}
    for value in np.unique(labels):
        own = rng.permutation(np.flatnonzero(labels == value))
        a = int(len(own) * train)
        b = a + int(len(own) * validation)
        for n, part in zip(names, np.split(own, [a, b]), strict=True):
            parts[n].append(part)
    return {n: rng.permutation(np.concatenate(parts[n]).astype(np.int64)) for n in names}


def reference_digest(indices: np.ndarray) -> str:
    return hashlib.sha256(np.sort(indices).astype(">i8").tobytes()).hexdigest()


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in the order of a seeded hash of their keys: a reproducible shuffle, sorted by range."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256), *keys)


def reference_shuffle(n: int, seed: int) -> list[int]:
    """The order that CPython's seeded generator gives to n rows, on the driver."""
    import random

    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def class_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
