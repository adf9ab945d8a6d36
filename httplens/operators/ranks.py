"""Exact order statistics of groups of any size, without sorting a group in one task.

A sketch gives each group splitters, counts of the buckets between them a prefix sum, and only the
buckets that hold a wanted rank are opened and sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Buckets of a group: so many times so many; a value is placed by two short searches.
FAN = 16


def keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of both that share the keys, null ones too; those of ``right`` are left out."""
    same = F.lit(True)
    for n, k in enumerate(keys):
        right = right.withColumnRenamed(k, f"__k{n}")
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    return left.join(right, same, how).drop(*[f"__k{n}" for n in range(len(keys))])


def at_ranks(counted: DataFrame, keys: Sequence[str], ranks: Column, fan: int = FAN) -> DataFrame:
    """(keys, total, found): for each group of (keys, value, n), n rows of each value, a map from each
    of ``ranks`` (an array of ranks from 0, as an expression over ``total``) to the value there.

    ``counted`` has each value of a group once and is read twice. Null values don't count. Splitters are
    written first, so that the engine knows how large they are when it chooses how to send them."""
    rows = counted.where("value is not null")
    edges = [i / (fan * fan) for i in range(1, fan * fan)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("value", edges, 100 * fan * fan).alias("cuts"))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda i: F.col("cuts")[i * fan - 1])
    within = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("value")))
    cuts = written(cuts.select(*keys, "cuts", coarse.alias("coarse")))
    placed = keyed(rows, cuts, keys).withColumn("__c", within(F.col("coarse")))
    fine = within(F.slice("cuts", F.col("__c") * fan + 1, F.lit(fan - 1)))
    placed = written(placed.select(*keys, "value", "n", (F.col("__c") * fan + fine).alias("bucket")))
    own = W.partitionBy(*keys)
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("n").alias("held"))
    sums = sums.select(*keys, "bucket", F.sum("held").over(own.orderBy("bucket")).alias("upto"), "held", F.sum("held").over(own).alias("total"))
    wanted = sums.select(*keys, "bucket", "total", (F.col("upto") - F.col("held")).alias("before"), "upto", F.explode(F.array_distinct(ranks)).alias("rank"))
    wanted = wanted.where("rank >= before and rank < upto")
    open_ = wanted.groupBy(*keys, "bucket", "before", "total").agg(F.collect_list("rank").alias("ranks"))
    inside = W.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    opened = keyed(placed, open_, [*keys, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    hit = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    found = opened.select(*keys, "total", "value", F.explode(hit).alias("rank"))
    return found.groupBy(*keys, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("found"))


def quantiles(counted: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, q): the quantiles at ``shares`` of each group of (keys, value, n), interpolated linearly
    between neighbours; groups without a value have no row."""
    place = [F.col("total").cast("double") - 1] * len(shares)
    place = [p * F.lit(float(q)) for p, q in zip(place, shares, strict=True)]
    both = [(F.floor(p).cast("bigint"), F.ceil(p).cast("bigint")) for p in place]
    told = at_ranks(counted, keys, F.array(*[r for pair in both for r in pair]))

    def between(p: Column, lo: Column, hi: Column) -> Column:
        a, b = F.col("found")[lo], F.col("found")[hi]
        return F.when(lo == hi, a).when(a == b, a).otherwise((hi - p) * a + (p - lo) * b)

    return told.select(*keys, F.array(*[between(p, *pair) for p, pair in zip(place, both, strict=True)]).alias("q"))


def nearest_rank(counted: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """(keys, q): the smallest value that so large a share of the group's rows doesn't exceed."""
    rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(share).cast("decimal(9,6)"))).cast("bigint") - 1
    told = at_ranks(counted, keys, F.array(rank))
    return told.select(*keys, F.col("found")[rank].alias("q"))
