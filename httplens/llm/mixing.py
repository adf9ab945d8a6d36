"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source has a weight and a schedule over training time t in [0, 1]; its demand up to t is the
integral of the schedule, scaled to its target. A document's first word stands at some place in
its source's stream, once in each pass over the source; inverting the demand at that place gives
the position of that copy in training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import release, staged

#: Weights and slopes of the schedule (weight 1 + slope * (2 t - 1)), given to sources in turn.
WEIGHTS, SLOPES = (1, 2, 3), (0.5, 0.0, -0.5)
#: No source is taken more often than this.
REPEATS = 3
#: Rows of a hash bucket, in which running sums are taken, if all rows were of one source.
BUCKET = 2048

_NOT_SPACE = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(_NOT_SPACE)), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with rank from 1, by code point, null last: numbers within ranges of a sort, and
    sums over the ranges before. What is gathered is a row for each range."""
    sorted_ = sources.sort(F.col("source").isNull(), "source").withColumn("n", F.monotonically_increasing_id())
    s = staged(sorted_.select("*", F.shiftright("n", 33).alias("range"), F.col("n").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = s.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return s.join(offsets, "range").withColumn("rank", F.col("offset") + F.col("nth") + 1).drop("n", "range", "nth", "offset")


def targets(sources: DataFrame, weights=WEIGHTS, slopes=SLOPES, repeats: int = REPEATS) -> DataFrame:
    """(source, size) to (source, size, rank, weight, slope, target, quota).

    Sources by code point, null last, get weights in turn and share the sum of all sizes. A target
    over ``repeats`` times its source's size stops there, and the excess is shared by weight among
    the rest, until none is above: each round is one sum over the sources. quota is the whole part
    of target. One row for each source."""
    wide = "decimal(38,0)"
    pick = lambda xs: F.array(*[F.lit(x) for x in xs])[(F.pmod(F.col("rank") - 1, F.lit(len(xs)))).cast("int")]
    s = numbered(sources).select("source", "size", "rank", pick(weights).cast("bigint").alias("weight"), pick(slopes).alias("slope"), (F.col("size") * repeats).alias("most"))
    s = staged(s)
    words, units = s.agg(F.sum("size"), F.sum("weight")).first()
    whole = words
    while True:
        stops = F.col("most").cast(wide) * F.lit(int(units or 0)).cast(wide) <= F.col("weight").cast(wide) * F.lit(int(words or 0)).cast(wide)
        stopped, left = s.agg(F.sum(F.when(stops, F.col("most"))), F.sum(F.when(~stops, F.col("weight")))).first()
        if not left or (whole - (stopped or 0), left) == (words, units):
            break
        words, units = whole - (stopped or 0), left
    shared = (F.col("weight") * F.lit(int(words or 0))).cast("double") / F.lit(float(units or 1))
    s = s.withColumn("target", F.when(stops, F.col("most").cast("double")).otherwise(F.least(shared, F.col("most").cast("double"))))
    return s.select("source", "size", "rank", "weight", "slope", "target", F.floor("target").cast("bigint").alias("quota"))


def order_hash(id_col, text) -> F.Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), order_hash(id_col, text).alias("h"), *more)


def _plan(rows: DataFrame, narrow: DataFrame, weights, slopes, repeats: int) -> DataFrame:
    """``rows`` (those of ``narrow``, with more columns or the same) with what the mix takes of each."""
    n, digits = narrow.count(), 1
    while BUCKET * 16**digits < n:
        digits += 1
    bucket = F.conv(F.substring("h", 1, digits), 16, 10).cast("bigint")
    buckets = staged(narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket")))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    goals = targets(buckets.groupBy("source").agg(F.sum("in_bucket").alias("size")), weights, slopes, repeats)
    goals = goals.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "slope", "target", "quota")
    told = offsets.join(goals, offsets["source"].eqNullSafe(goals["of"])).select(F.col("source").alias("of"), F.col("bucket").alias("in"), "offset", "source_size", "slope", "target", "quota")
    told = staged(told)
    release(buckets)
    inside = W.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.withColumn("bucket", bucket).withColumn("upto", F.sum("size").over(inside))
    run = run.join(told, run["source"].eqNullSafe(told["of"]) & (run["bucket"] == told["in"]))
    whole = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0))
    run = run.select("*", (F.col("offset") + F.col("upto") - F.col("size")).alias("begin"), whole.alias("copies"))
    rest = F.col("quota") - F.col("copies") * F.col("source_size")
    run = run.withColumn("part", F.greatest(F.lit(0), F.least("size", rest - F.col("begin"))))
    run = run.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    g = F.col("slope")

    def at(begin: F.Column) -> F.Column:
        y = F.try_divide(begin.cast("double"), F.col("target"))
        return (2 * y) / ((1 - g) + F.sqrt((1 - g) * (1 - g) + 4 * g * y))

    passes = F.col("copies") + (F.col("part") > 0).cast("bigint")
    each = F.transform(F.sequence(F.lit(0).cast("bigint"), passes - 1), lambda n: at(n * F.col("source_size") + F.col("begin")))
    return run.withColumn("positions", F.when(F.col("taken") > 0, each).otherwise(F.array().cast("array<double>")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, slopes=SLOPES, repeats: int = REPEATS) -> DataFrame:
    """(id, size, source, source_size, target, taken, copies, part, positions) of every row, sorted
    by the first of its positions, rows of which nothing is taken last.

    Documents of a source stand in order of a hash of id and text. Each is taken ``copies`` whole
    times, and the words up to the source's quota that remain come from the first documents once
    more: ``part`` words of each, all of them but in the last. So taken words meet the target to
    less than one word, and none exceeds ``repeats`` times its size. positions (0 to 1, empty if
    nothing is taken) is when the first word is due in each pass that takes it: pass n of a document
    begins where n passes over its source and the documents before it end. One for each copy and,
    where ``part`` isn't 0, one for the part.

    Null text has size 0, null is a source of its own, null ids hash as the empty string; rows that
    repeat an id are taken each for itself; equal rows stand next to each other, all in one bucket;
    an empty table gives an empty result; other columns are ignored. Reruns agree: nothing depends
    on partitions."""
    rows = staged(_rows(df, id_col, text_col, source_col))
    run = _plan(rows, rows, weights, slopes, repeats)
    out = run.sort(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "h")
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "taken", "copies", "part", "positions")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, slopes=SLOPES, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``df`` as the mix takes them, in order of position: each ``copies`` times, and
    once more if half its words or more are in ``part``. A row stands once for each time it is
    taken, at the position of that copy; all columns stay, whatever their names. Rows that repeat
    an id are taken each for itself; nulls, equal rows and empty tables as in ``mix``."""
    narrow = staged(_rows(df, id_col, text_col, source_col))
    rows = _rows(df, id_col, text_col, source_col, F.struct(*[df[c] for c in df.columns]).alias("row"))
    plan = _plan(rows, narrow, weights, slopes, repeats).where("taken > 0")
    times = (F.col("copies") + (F.col("part") * 2 >= F.col("size")).cast("bigint")).cast("int")
    plan = plan.select("row", "h", F.posexplode(F.slice("positions", F.lit(1), times)).alias("nth", "at"))
    return plan.sort("at", "h", "nth").select("row.*")
