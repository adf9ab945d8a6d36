"""Exact statistics of many numeric columns in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import ranks

QUANTILES = ((0.01, "p01"), (0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99"))
#: Distinct values beyond which only that there are more is told.
DISTINCT = 10_000


def long_form(df: DataFrame, columns: list[str], keys: list[Column] | None = None) -> DataFrame:
    """(keys, feature, value): one row for each column, from one scan."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.select(*(keys or []), F.expr(f"stack({len(columns)}, {pairs}) as (feature, value)"))


def summary(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), without_distinct: tuple[str, ...] = ()) -> DataFrame:
    """Per key and feature: total, valid, missing (null or not finite), share valid, min, max, mean,
    population deviation, interpolated percentiles, zeros, share non-zero, distinct values.

    Values are first counted per distinct value. Percentiles open only the buckets that hold a wanted
    rank (see ``ranks``), so no task sorts a feature. Deviations are moments of the counts times the
    values' distances from the mean, so a large common offset costs no digits."""
    rows = long_form(df, columns, [F.col(k) for k in keys])
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    counted = written(rows.groupBy(*keys, "feature", value.alias("value")).agg(F.count("*").alias("n")))
    n, v, on = F.col("n"), F.col("value"), [*keys, "feature"]
    valid_n = F.sum(F.when(v.isNotNull(), n))
    first = counted.groupBy(*on).agg(
        F.sum(n).alias("total"), F.coalesce(valid_n, F.lit(0)).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.try_divide(F.sum(v * n), valid_n).alias("mean"),
        F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zeros"), F.count(v).alias("__distinct"),
    )
    off = v - F.col("mean")
    moments = ranks.keyed(counted.where("value is not null"), first.select(*on, "mean", "valid"), on)
    moments = moments.groupBy(*on, "valid").agg(F.sum(off * off * n).alias("s"), F.sum(off * n).alias("d"))
    moments = moments.select(*on, F.try_divide("s", "valid").alias("__square"), F.try_divide("d", "valid").alias("__shift"))
    percentiles = ranks.quantiles(counted, on, [q for q, _ in QUANTILES]).withColumnRenamed("q", "__q")
    grouped = ranks.keyed(ranks.keyed(first, moments, on, "left"), percentiles, on, "left")
    share = lambda a, b: F.bround(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 4)
    distinct = F.when(F.col("__distinct") > DISTINCT, F.lit(f">{DISTINCT}")).otherwise(F.col("__distinct").cast("string"))
    return grouped.select(
        *keys, "feature", "total", "valid", (F.col("total") - F.col("valid")).alias("missing"), share(F.col("valid"), F.col("total")).alias("valid_percent"),
        "min", "max", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("__square") - F.col("__shift") * F.col("__shift"))).alias("stddev"),
        *[F.col("__q")[i].alias(name) for i, (_, name) in enumerate(QUANTILES)], "zeros", (F.col("valid") - F.col("zeros")).alias("nonzeros"),
        share(F.col("valid") - F.col("zeros"), F.col("valid")).alias("nonzero_percent"),
        F.when(F.col("feature").isin(*without_distinct), F.lit(None)).otherwise(distinct).alias("distinct_values") if without_distinct else distinct.alias("distinct_values"),
    )


def sketched(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), accuracy: int = 10_000) -> DataFrame:
    """``summary`` for columns of too many distinct values for exact percentiles: quantile sketches of
    a rank error of 1 / accuracy, and approximate distinct counts. Each task sends one sketch for each
    key and feature, whatever its rows."""
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    rows = long_form(df, columns, [F.col(k) for k in keys]).withColumn("v", value)
    q = F.percentile_approx("v", [x for x, _ in QUANTILES], accuracy)
    found = rows.groupBy(*keys, "feature").agg(
        F.count("*").alias("total"), F.count("v").alias("valid"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), q.alias("__q"),
        F.count_if(F.col("v") == 0).alias("zeros"), F.approx_count_distinct("v").alias("distinct_values"),
    )
    return found.select(*keys, "feature", "total", "valid", (F.col("total") - F.col("valid")).alias("missing"), "min", "max", "mean", "stddev", *[F.col("__q")[i].alias(n) for i, (_, n) in enumerate(QUANTILES)], "zeros", "distinct_values")


def binary_frequencies(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key and feature, a map of each value to its count (for features of few values)."""
    rows = long_form(df, columns, [F.col(k) for k in keys]).where("value is not null")
    counted = rows.groupBy(*keys, "feature", "value").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("value").cast("string").alias("key"), F.col("n").alias("value"))))
    return counted.groupBy(*keys, "feature").agg(F.map_from_entries(entries).alias("frequencies"))


def quantile_caps(df: DataFrame, columns: list[str], q: float = 0.995, signed: tuple[str, ...] = ()) -> DataFrame:
    """(feature, cap): the quantile of the values, of their size for signed ones; 1 if not above 0."""
    rows = long_form(df, columns)
    value = F.when(F.col("feature").isin(*signed), F.abs("value")).otherwise(F.col("value")) if signed else F.col("value")
    every = rows.select("feature", value.alias("value")).groupBy("feature", "value").agg(F.count("*").alias("n"))
    every = written(every)
    found = every.select("feature").distinct().join(ranks.quantiles(every, ["feature"], [q]), "feature", "left")
    cap = F.col("q")[0]
    return found.select("feature", F.when(cap > 0, cap).otherwise(1.0).alias("cap"))


def with_catalog(summaries: DataFrame, catalog: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Every feature of the catalog for every dataset there is, with its statistics where there are
    any. Both sides of the combination are short: features of a catalog and names of datasets."""
    names = summaries.select(dataset).distinct().agg(F.collect_set(dataset).alias("__names"))
    every = catalog.join(names, F.lit(True)).withColumn(dataset, F.explode("__names")).drop("__names")
    return every.join(summaries, ["feature", dataset], "left")
