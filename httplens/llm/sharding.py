"""Sharding by extendible hashing.

A directory indexed by leading bits of a key's hash: every bucket over the byte limit is split on
one more bit, the others stay as they are. Sizes are first summed per run of ``STEP`` bits (with
partial sums before the shuffle) and rolled up to each shorter prefix, so up to ``STEP`` splits
cost one pass over a narrow table (id, hash, bytes); only rows of buckets that are still too large
take part in the next pass. The directory is a table, joined by key, and is never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import release, staged

#: Production limit of a shard, in bytes of text.
LIMIT = 1 << 20
#: Bits of the hash that are read in one pass, and bits that one hash has.
STEP, WIDTH = 12, 60


def key_hash(col) -> F.Column:
    """The first 60 bits of the MD5 of the key as text, as a non-negative integer."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes, shard_rows, oversize) of every row.

    shard is the bucket's prefix as a string of 0 and 1, of ``depth`` bits; a bucket of one row
    that alone exceeds the limit is kept whole and marked oversize. Rows that repeat an id share
    all bits of their hash, so once these are used up they are dealt by a hash of their text, and
    rows equal in both by a number of their own: any number of copies of one id (or of null ids,
    which hash as the empty string) is split as well. Reruns agree but for which of equal rows is
    in which shard.
    Null or empty text has zero bytes; an empty table gives an empty result; other columns are
    ignored."""
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
        key_hash(id_col).alias("h"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.lit("").alias("base"),
    )
    rows, used, done, first, mask = staged(rows), 0, [], True, F.lit((1 << WIDTH) - 1)
    others = iter([lambda: F.col("t").bitwiseAND(mask)])
    while first or not rows.isEmpty():
        first = False
        if used + step > WIDTH:
            own = next(others, lambda: F.xxhash64(F.monotonically_increasing_id(), "h").bitwiseAND(mask))
            dealt = staged(rows.withColumn("h", own()))
            release(rows)
            rows, used = dealt, 0
        bin_of = F.shiftright("h", WIDTH - used - step).bitwiseAND(F.lit((1 << step) - 1))
        here = rows.withColumn("bin", bin_of)
        bins = here.groupBy("base", "bin").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        deep = bins.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(step)))).withColumn("prefix", F.expr(f"shiftright(bin, {step} - d)"))
        nodes = deep.groupBy("base", "d", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        met = deep.select("base", "bin", "d", "prefix").join(fits, ["base", "d", "prefix"])
        leaf = met.groupBy("base", "bin").agg(F.min_by(F.struct("d", "prefix", "shard_bytes", "shard_rows"), "d").alias("leaf"))
        found = staged(here.join(leaf, ["base", "bin"], "left"))
        bits = F.when(F.col("leaf.d") > 0, F.lpad(F.bin("leaf.prefix"), F.col("leaf.d"), F.lit("0"))).otherwise(F.lit(""))
        done.append(found.where("leaf is not null").select("id", "n_bytes", F.concat("base", bits).alias("shard"), "leaf.shard_bytes", "leaf.shard_rows"))
        left = found.where("leaf is null").select("id", "n_bytes", "h", "t", F.concat("base", F.lpad(F.bin("bin"), step, "0")).alias("base"))
        rows, used = left, used + step
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(
        F.col("id").alias(id_col), "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows",
        (F.col("shard_bytes") > limit).alias("oversize"),
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Write the rows of ``df`` to ``path``, one folder (``__shard``) for each shard; returns the
    assignment. Each id must have one row: an id with several is refused."""
    dealt = staged(assign(df, id_col, text_col, limit))
    if not dealt.groupBy(id_col).count().where("count > 1").isEmpty():
        raise ValueError(f"{id_col} repeats")
    of = dealt.select(F.col(id_col).alias("__id"), F.col("shard").alias("__shard"))
    rows = df.join(of, df[id_col].eqNullSafe(F.col("__id"))).drop("__id")
    rows.repartition("__shard").write.partitionBy("__shard").parquet(path)
    return dealt
