"""Connected components of an edge table, without gathering anything on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import release, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with an edge to another; root is the smallest node reachable.

    Alternates two star steps until the edges stand still: in the large star each node links its
    larger neighbours to the smallest node it knows, in the small star its smaller ones. Both are
    a minimum per key (combined before the shuffle) and an equality join, so a hub is a skewed
    join that the engine splits, and rounds grow with the logarithm of the longest path.
    The result reads a staged table, which ``release`` of the result deletes.
    Edges with a null end or from a node to itself are ignored; an empty table gives none."""
    now = staged(_ordered(edges.select(F.col(a).alias("hi"), F.col(b).alias("lo"))))
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            out = now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct().toDF("node", "root"))
            out._staged_at = now._staged_at
            return out
        seen = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = staged(_ordered(large))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        after = staged(_ordered(small.union(least.select("hi", F.col("m").alias("lo")))))
        release(now, large)
        now = after


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct()
